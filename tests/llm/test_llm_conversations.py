"""Structure repair, prefix tries and repeated passages against brute force: nulls, ties, repeats, long and empty inputs, hot groups."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from tidemark.llm import checks, repair, repeats, trie
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
AFTER = {"": "su", "s": "u", "u": "a", "a": "u"}  # what may be said after each initial
NEW = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(initials: list[str], faults: str) -> tuple[int, str]:
    """Cost and audit by the least (cost, audit) for each row and last initial; b, d, t, f are the rows' faults."""

    def inserted(best):
        for _ in range(8):
            for last, (cost, said) in list(best.items()):
                found = (cost + 5, said + "I")
                best[NEW[last]] = min(found, best.get(NEW[last], found))
        return best

    best = {"": (0, "")}
    for initial, fault in zip(initials, faults, strict=True):
        options = []
        for last, (cost, said) in inserted(best).items():
            options.append((last, (cost + 2, said + "D")))
            if fault in "tf":
                more = 5 if fault == "t" else 0
                options.append((NEW[last], (cost + 1 + more, said + "R")))
                if initial and initial in AFTER[last]:
                    options.append((initial, (cost + more, said + "K")))
        best = {}
        for last, found in options:
            best[last] = min(found, best.get(last, found))
    return min(v for last, v in inserted(best).items() if last in ("", "a"))


def repairs(rows):
    conversations = defaultdict(list)
    for conv, turn, role, text in rows:
        shown = [" " if x is None else x for x in (conv, turn, role, text)]
        conversations[conv].append(((turn is not None, turn or 0), shown[2], shown[3], zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20, turn))
    for conv, own in conversations.items():
        after = []
        for _, role, text, fault, turn in sorted(own, key=lambda r: r[:3]):
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            after += [(turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
        faults, seen = "", set()
        for _, role, text in after:
            bare = text.strip(" \t\n\v\f\r")
            faults += "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "f"
            seen.add((role, text))
        initials = [role[:1] for _, role, _ in after]
        cost, audit = cheapest(initials, faults)
        out, left, last = [], list(after), ""
        for edit in audit:
            role, text = ("", "") if edit == "I" else left.pop(0)[1:]
            if edit != "D":
                last = role[0] if edit == "K" else NEW[last]
                out.append((role if edit == "K" else {"u": "user", "a": "assistant"}[last], text))
        turns = {t for t, _, _ in after if t is not None}
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        yield conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, sha


def nodes(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [r[1:] for r in sorted(v)] for c, v in own.items()}
    whole = {}
    for conv, v in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        base = abs(conv) // 100 * 100 * (1 if conv >= 0 else -1)
        whole[conv] = own.get(base, [])[:h] + v[h:]
    members, children = defaultdict(list), defaultdict(list)
    for conv, v in whole.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(conv)
    for prefix in members:
        if prefix:
            children[prefix[:-1]].append(prefix)
    leaves, saved = {}, {}
    for prefix in sorted(members, key=len, reverse=True):
        below = children[prefix]
        leaves[prefix] = sum(leaves[x] for x in below) or 1
        saved[prefix] = sum(saved[x] for x in below) + ((len(members[prefix]) - 1) * len(prefix[-1][1]) if prefix else 0)
    for prefix, held in members.items():
        ends = ",".join(str(c) for c in sorted(held) if len(whole[c]) == len(prefix))
        above = min(members[prefix[:-1]]) if prefix else None
        yield min(held), len(prefix), above, len(held), len(children[prefix]), leaves[prefix], saved[prefix], hashlib.sha256(ends.encode()).hexdigest()


def passages(rows):
    size, first = repeats.WINDOW, {}
    own = [(-(1 << 63) if i is None else i, (t or "").encode().split()) for i, t in rows]
    for doc, words in own:
        for k in range(len(words) - size + 1):
            window = tuple(words[k : k + size])
            first[window] = min(doc, first.get(window, doc))
    for (i, _), (doc, words) in zip(rows, own, strict=True):
        gone = [False] * len(words)
        for k in range(len(words) - size + 1):
            if first[tuple(words[k : k + size])] < doc:
                gone[k : k + size] = [True] * size
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        yield i, len(words), sum(gone), hashlib.sha256(kept).hexdigest()


def show(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(11)
    rows = [(None, 1, "user", "no conversation."), (None, 2, "assistant", "none"), (700, 0, None, None), (701, None, "", "x."), (701, None, "", "x.")]
    for conv in range(-120, 330, 3):
        for k in range(rng.randrange(9)):
            rows.append((conv, rng.choice([k, k, None, k - 1]), rng.choice(["user", "assistant", "system", None, "usher", ""]), rng.choice(["x", "yy.", "", None, "é! ", "A? b.", " \n"])))
    rows += [(900 + k, t, "user" if t % 2 == 0 else "assistant", f"same {t}.") for k in range(120) for t in range(4)]
    rows += [(2000 + k, t, "user", "long") for k in range(2) for t in range(250 + k)]
    return rows


@pytest.fixture(scope="module")
def conversations(spark, turns):
    rows = [(*r, 1, "clash", "x", k) for k, r in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies int, was_role string, key string, place int").repartition(5)


def test_audits_of_random_conversations():
    rng = random.Random(5)
    for _ in range(1500):
        n = rng.randrange(45)
        initials = [rng.choice(["s", "u", "a", "a", "x", ""]) if rng.random() < 0.5 else "ua"[k % 2] for k in range(n)]
        faults = [rng.choices(range(4), [1, 1, 2, 8])[0] for _ in range(n)]
        assert repair.audit(initials, faults) == cheapest(initials, "".join("bdtf"[f] for f in faults))


def test_long_audits_take_time_in_proportion():
    rng = random.Random(6)
    cost, edits = repair.audit([rng.choice("sua") for _ in range(30_000)], [rng.choices(range(4), [1, 1, 2, 8])[0] for _ in range(30_000)])
    assert cost > 10_000 and len(edits) >= 30_000


def test_repair(conversations, turns):
    assert show(repair.repair(conversations).collect()) == show(repairs(turns))
    assert repair.repair(conversations.limit(0)).collect() == []


def test_repaired_turns_follow_the_grammar(conversations):
    said = defaultdict(dict)
    for r in repair.repaired_turns(conversations).collect():
        said[r["conv_id"]][r["place"]] = r["role"][0]
    for own in said.values():
        assert re.fullmatch("s?(ua)+", "".join(own[k] for k in range(len(own))))


@pytest.mark.parametrize("block", [5, 70, 20_000])
def test_trie(conversations, turns, block):
    assert show(trie.conversation_trie(conversations, block).collect()) == show(nodes(turns))


def test_trie_of_nothing_and_of_turnless_conversations(spark, conversations):
    assert trie.conversation_trie(conversations.limit(0)).collect() == []
    rows = [(100 * k + 51, t, "user", "own") for k in range(40) for t in range(3)]
    got = trie.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert show(got.collect()) == show(nodes(rows))


def test_extents_are_those_of_a_scan():
    rng = np.random.default_rng(3)
    lcp = rng.integers(0, 5, 300)
    lcp[0] = 0
    row, depth = rng.integers(0, 300, 2000), rng.integers(0, 6, 2000)
    left, right = trie.extents(trie.sparse_table(lcp), row, depth)
    for i, d, a, b in zip(row, depth, left, right, strict=True):
        low, high = i, i
        while low > 0 and lcp[low] >= d:
            low -= 1
        while high < 299 and lcp[high + 1] >= d:
            high += 1
        assert (low, high) == (a, b)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    word = lambda: rng.choice(["al", "be", "ga", "de", "Ep", "ze", "é", "日本"]) + rng.choice("abcdefgh")
    passage, second = [word() for _ in range(90)], [word() for _ in range(50)]
    rows: list[tuple[int | None, str | None]] = [(1, None), (2, ""), (3, " \t\n"), (None, " ".join(passage)), (None, None), (4, " ".join(passage[:49])), (5, "again " * 130), (6, "again " * 70), (7, "a b " * 60)]
    rows += [(8, " ".join(passage)), (8, " ".join(passage)), (8, " ".join(passage[10:80])), (9, "\x0b".join(second) + " x")]
    for k in range(150):  # a passage of most documents, at different places, some with a word changed
        own = list(passage)
        if k % 3 == 0:
            own[rng.randrange(90)] = word()
        rows.append((20 + rng.randrange(200), " ".join([word() for _ in range(rng.randrange(60))] + own + [word() for _ in range(rng.randrange(60))])))
    rows += [(300 + k, " ".join(word() for _ in range(rng.randrange(120)))) for k in range(60)]
    rows += [(400, " ".join([word() for _ in range(20_000)] + second + passage)), (401, " ".join(second + second[:20]))]
    return rows


@pytest.mark.parametrize("most_met", [2, repeats.MOST_MET])
def test_repeated_passages(spark, texts, most_met, monkeypatch):
    monkeypatch.setattr(repeats, "MOST_MET", most_met)
    rows = [(i, t, "x", 1, b"", k) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mini string, n_words int, sha binary, doc int").repartition(4)
    assert show(repeats.remove_repeats(docs).collect()) == show(passages(texts))
    assert repeats.remove_repeats(docs.limit(0)).collect() == []
    kept = {(r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in repeats.without_repeats(docs).collect()}
    assert kept == {(i, sha) for i, _, _, sha in passages(texts)}


def test_equal_hashes_are_told_apart_by_words(monkeypatch):
    monkeypatch.setattr(repeats, "window_hashes", lambda ids: np.zeros(len(ids) - repeats.WINDOW + 1, np.uint64))
    words = [b"w%d" % k for k in range(60)]
    packed = [b" ".join(words), b" ".join(words[5:]), b" ".join([b"x", *words[1:]])]
    found = repeats.least_holders(packed, np.array([7, 3, 5]))
    assert [x.tolist() for x in found] == [[7] + [5] * 4 + [3] * 6, [3] * 6, [5] + [5] * 4 + [3] * 6]


@pytest.mark.parametrize("name,sql", [("op11_structure_repair", checks.OP11), ("op12_substring_dedup", checks.OP12), ("op13_prefix_trie", checks.OP13)])
def test_queries_agree_with_sql(spark, name, sql):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    ran = con.execute(sql)
    columns = [c[0] for c in ran.description]
    assert show(QUERIES[name](spark, SF).select(*columns).collect()) == show(ran.fetchall())
