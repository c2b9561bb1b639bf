"""The parts of the operators: codecs, automata, registers, plans, chat events."""

from __future__ import annotations

import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import chat, dedup, jpeg, packing, sentencepiece, shingles, toxicity, wordpiece
from tidemark.llm.queries import REPLY_SCHEMA, pre_token_pattern, tokenizer
from pyspark.sql import functions as F

ODD = st.text(st.sampled_from(list("aetho .,\n\té▁的😀<s>0１'") + [" "]), max_size=60)


@pytest.fixture(scope="module")
def piece_model():
    with open(tokenizer("piece_bpe_32k.model"), "rb") as f:
        return sentencepiece.PieceModel(f.read())


@pytest.fixture(scope="module")
def piece_library():
    import sentencepiece as library

    return library.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))


@settings(max_examples=400, deadline=None)
@given(text=ODD | st.text(max_size=40))
def test_pieces_equal_the_library(piece_model, piece_library, text):
    ids = [x[0] for x in struct.iter_unpack("<I", piece_model.encode(text))]
    assert ids == piece_library.encode(text, add_bos=True, add_eos=True)
    assert piece_model.decode(ids) == piece_library.decode(ids)


@settings(max_examples=200, deadline=None)
@given(ids=st.lists(st.integers(3, 31_999) | st.integers(3, 258), max_size=12))
def test_decoding_any_ids(piece_model, piece_library, ids):
    assert piece_model.decode(ids) == piece_library.decode(ids)


def test_long_runs(piece_model, piece_library):
    for text in ("a" * 5000, "ab" * 40_000, " " * 3000 + "x", "x y" * 3000, "的" * 9000):
        assert [x[0] for x in struct.iter_unpack("<I", piece_model.encode(text))] == piece_library.encode(text, add_bos=True, add_eos=True)


@settings(max_examples=60, deadline=None)
@given(parts=st.lists(st.binary(max_size=900), min_size=1, max_size=6))
def test_jpeg_round_trip(parts):
    payloads = [jpeg.pad(p) for p in parts]
    stored = jpeg.encode(payloads)
    assert [p for p, _ in jpeg.decode(stored)] == payloads
    assert jpeg.decode_thumbnail(stored[0]).tobytes() == payloads[0]


def test_jpeg_of_a_large_payload():
    payload = jpeg.pad(np.random.default_rng(1).integers(0, 256, 2_000_003, dtype=np.uint8).tobytes())
    assert jpeg.decode(jpeg.encode([payload]))[0][0] == payload


def test_jpeg_refuses_other_kinds():
    stored = jpeg.encode([jpeg.pad(b"x")])[0]
    with pytest.raises(ValueError):
        jpeg.decode([stored.replace(b"\xff\xc0", b"\xff\xc2", 1)])
    with pytest.raises(ValueError):
        jpeg.decode([b"no picture"])


@pytest.mark.parametrize("seed", range(3))
def test_count_automaton_is_greedy(seed):
    rng = random.Random(seed)
    make = lambda n: {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(n)}
    begins, goes_on = make(8), make(8)
    a = wordpiece.CountAutomaton(begins, goes_on)
    for _ in range(3000):
        w = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12)))
        at = n = 0
        while at < len(w):
            table = goes_on if at else begins
            end = next((e for e in range(len(w), at, -1) if w[at:e] in table), None)
            if end is None:
                n = 0
                break
            at, n = end, n + 1
        assert a.count(w) == n


@settings(max_examples=200, deadline=None)
@given(values=st.sets(st.integers(0, 5000), max_size=200), k=st.integers(0, 9))
def test_golomb(values, k):
    own = np.array(sorted(values), np.int64) + 1000
    assert (dedup.golomb_decode(dedup.golomb_encode(own, 1000, k), len(own), 1000, k) == own).all()


@settings(max_examples=300, deadline=None)
@given(text=st.lists(st.sampled_from([*"aeth .,\n\té的😀'0１²", "<|endoftext|>", "  ", " \n"]), max_size=40).map("".join))
def test_byte_bpe_equals_the_library(text):
    from tokenizers import Tokenizer

    cache = test_byte_bpe_equals_the_library.__dict__
    if "pair" not in cache:
        path = tokenizer("byte_bpe_50k.json")
        with open(path, "rb") as f:
            cache["pair"] = packing.ByteBpe(f.read(), pre_token_pattern()), Tokenizer.from_file(path)
    own, library = cache["pair"]
    assert np.frombuffer(own.encode(text), np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids


def test_plan_is_whole_and_tight():
    rng = random.Random(2)
    counts = {rng.randrange(1, 101): rng.randrange(1, 50) for _ in range(60)}
    used: dict[int, list] = {}
    seen = {k: 0 for k in counts}
    for length, a, b, first, offset in packing.best_fit_plan(counts, 100):
        seen[length] += b - a
        for s in range(first, first + b - a):
            used.setdefault(s, []).append((offset, length))
    assert seen == counts
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 100
    bins: list[int] = []  # best-fit-decreasing, one piece after the other
    for size in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        fit = min((b for b in range(len(bins)) if bins[b] >= size), key=lambda b: bins[b], default=None)
        if fit is None:
            bins.append(100 - size)
        else:
            bins[fit] -= size
    assert len(used) == len(bins)


def test_registers_estimate_similarity():
    rng = np.random.default_rng(3)
    for n in (5, 60, 600, 20_000):
        for share in (0.5, 0.8, 0.95):
            both = int(2 * n * share / (1 + share))
            diffs = []
            for _ in range(60):
                x = np.unique(rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64) * np.uint64(2))
                a = np.sort(rng.permutation(x)[:n])
                common = rng.permutation(a)[:both]
                b = np.sort(np.concatenate([common, np.setdiff1d(x, a)[: n - both]]))
                j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
                diffs.append(shingles.estimates(np.array([(shingles.registers(a) == shingles.registers(b)).mean()]), np.array([len(a)]), np.array([len(b)]))[0] - j)
            assert abs(np.mean(diffs)) < 0.04


def test_machine_learns_pairs():
    """Two terms that are harmless alone and toxic together: beyond any linear weights."""
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(2000):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.array([k for k, on in enumerate((a, b)) if on] + [2 + int(rng.integers(0, 6))], np.int64))
        labels.append(float(a and b))
    m = toxicity.train(rows, np.array(labels), np.arange(8, dtype=np.int32))
    assert m.margin([0, 1]) > 0 > max(m.margin([0]), m.margin([1]), m.margin([2]))


def test_tool_calls(spark):
    call = lambda i, name, args, needs="[]": '{"tool_call":{"id":"%s","name":"%s","arguments":%s,"needs":%s}}' % (i, name, args, needs)
    rows = [
        (1, 0, "user", "find it"), (1, 1, "assistant", call("b", "get", '{"n":2,"q":"x"}', '["a"]')), (1, 2, "tool", '{"tool_result":{"id":"b"}}'),
        (1, 3, "assistant", call("a", "get", '{"q":7}')), (1, 4, "tool", '{"tool_result":{"id":"a"}}'), (1, 5, "assistant", call("a", "get", '{"q":"again"}')),
        (1, 6, "tool", '{"tool_result":{"id":"nobody"}}'), (2, 0, "assistant", call("p", "get", "[1]", '["r"]')), (2, 1, "assistant", call("r", "get", '{"q":"x","z":1}', '["p"]')),
        (None, None, None, None), (3, 0, "assistant", call("u", "other", "{}")),
    ]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    schema = {"get": {"required": ["q"], "properties": {"q": {"type": "string"}, "n": {"type": "integer", "maximum": 5}}, "additionalProperties": False}}
    got = {(r.conv_id, r.turn): r for r in chat.link_calls(chat.embedded_events(m), schema).collect()}
    assert len(got) == len(rows)
    assert [got[1, t].link for t in range(7)] == [None, "linked", "linked", "linked", "linked", "repeated", "orphan"]
    assert got[1, 1].invalid is None and got[1, 3].invalid == "q is no string" and got[3, 0].invalid == "unknown tool"
    assert got[2, 0].invalid == "arguments are no object" and got[2, 1].invalid == "an unknown field"
    order = [t for *_, t in sorted((got[1, t].order_turn, got[1, t].order_level, t) for t in range(5))]
    assert order == [0, 3, 4, 1, 2]
    assert got[2, 0].cyclic and got[2, 1].cyclic and not got[1, 1].cyclic
    import json

    for r in got.values():
        doc = json.loads(r.json)
        assert list(doc) == sorted(doc) and json.dumps(doc, separators=(",", ":"), ensure_ascii=False) == r.json
    assert json.loads(got[1, 1].json)["arguments"] == {"n": 2, "q": "x"}


def test_plain_replies(spark):
    rows = [(1, 0, "user", 'say "hi"\n'), (1, 1, "assistant", "hi"), (1, 1, "assistant", "hi"), (1, 2, "user", ""), (2, 3, "assistant", "alone")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.link_calls(chat.reply_events(m), REPLY_SCHEMA)
    links = got.groupBy("conv_id", "turn", "link").agg(F.count("*").alias("n"), F.max("invalid").alias("bad")).orderBy("conv_id", "turn").collect()
    assert [tuple(r) for r in links] == [(1, 0, "linked", 1, None), (1, 1, "linked", 2, None), (1, 2, "unanswered", 1, "text is too short"), (2, 3, "orphan", 1, None)]
    assert chat.link_calls(chat.reply_events(m.limit(0)), REPLY_SCHEMA).count() == 0


def _call(name: str, needs: list[str]) -> str:
    return '{"tool_call":{"id":"%s","name":"get","arguments":{},"needs":[%s]}}' % (name, ",".join(f'"{n}"' for n in needs))


def test_a_chain_of_calls_of_any_length_is_no_cycle(spark):
    n = 300
    rows = [(1, n - k, "assistant", _call(f"c{k}", [f"c{k - 1}"] if k else [])) for k in range(n)]
    rows += [(2, 0, "assistant", _call("p", ["q"])), (2, 1, "assistant", _call("q", ["p"])), (2, 2, "assistant", _call("behind", ["q", "free"])), (2, 3, "assistant", _call("free", []))]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.event_id): r for r in chat.link_calls(chat.embedded_events(m), {"get": {}}).collect()}
    assert all((r.order_turn, r.order_level, r.cyclic) == (n, k, False) for k in range(n) for r in [got[1, f"c{k}"]])
    assert {e for (c, e), r in got.items() if r.cyclic} == {"p", "q", "behind"}


def test_places_of_calls_equal_a_plain_walk(spark):
    rng = random.Random(11)
    rows, turns, answers, needs = [], {}, {}, {}
    for k in range(60):
        turns[k], needs[k] = rng.randrange(100), sorted(rng.sample(range(k), min(k, rng.choice((0, 1, 1, 1, 2, 3)))))
        rows.append((1, turns[k], "assistant", _call(f"c{k}", [f"c{x}" for x in needs[k]])))
        if rng.random() < 0.5:
            answers[k] = rng.randrange(100)
            rows.append((1, answers[k], "tool", '{"tool_result":{"id":"c%d"}}' % k))
    want = {}
    for k in range(60):
        after = max(((a, v) if (r := answers.get(x)) is None else (r, 0) if r > a else (a, v + 1) for x in needs[k] for a, v in [want[x]]), default=(-1, 0))
        want[k] = (after[0], after[1] + 1) if after[0] >= turns[k] else (turns[k], 0)
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.link_calls(chat.embedded_events(m), {"get": {}}).filter("kind = 'call'").collect()
    assert {r.event_id: (r.order_turn, r.order_level, r.cyclic) for r in got} == {f"c{k}": (*want[k], False) for k in range(60)}


def test_plain_replies_run_the_ordering(spark, monkeypatch):
    rows = [(c, t, "assistant" if t % 2 else "user", f"text {t}") for c in (1, 2) for t in range(40)] + [(3, 0, "user", "a"), (3, 0, "user", "b"), (3, 2, "user", "c"), (None, None, "user", None)]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    needs = {r.turn: r.needs for r in chat.reply_events(m.filter("conv_id = 1")).collect() if r.call_id}
    assert needs[4] == ["7"] and needs[6] == ["1"]
    gathered = []
    monkeypatch.setattr(chat.Scratch, "save", lambda self, df, _save=chat.Scratch.save: gathered.append(1) or _save(self, df))
    got = chat.link_calls(chat.reply_events(m), REPLY_SCHEMA).collect()
    assert len(got) == len(rows) and len(gathered) > 3

    def place(turn: int) -> tuple[int, int]:
        """Of the call at ``turn`` in conversations 1 and 2: no earlier than the result it needs, which comes after its own call."""
        need = int(needs[turn][0]) - 1
        if need not in needs:
            return turn, 0
        at, level = place(need)
        return max((turn, 0), (need + 1, 1), (at, level + 2))

    for r in got:
        assert not r.cyclic
        if r.conv_id in (1, 2):
            at, level = place(r.turn - r.turn % 2)
            assert (r.order_turn, r.order_level) == ((at, level + r.turn % 2) if at >= r.turn else (r.turn, 0))
    assert sum(r.order_turn > r.turn for r in got if r.turn is not None) >= 20 and max(r.order_level for r in got) == 2


def test_arguments_are_written_canonically(spark):
    args = '{"q" : "x\\u0041\\n", "n": 2, "deep": {"z": [1, {"b": null, "a": 1.50}], "c": true}}'
    rows = [(1, 0, "assistant", '{"tool_call":{"id":"a","name":"get","arguments":%s,"needs":[]}}' % args), (1, 1, "tool", '{"tool_result":{"id":"a"}}')]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.kind: r for r in chat.link_calls(chat.embedded_events(m), {"get": {}}).collect()}
    assert got["call"].json.startswith('{"arguments":{"deep":{"c":true,"z":[1,{"a":1.5,"b":null}]},"n":2,"q":"xA\\n"},"content":null,')


NUMBERS = [("1e2", "100"), ("100", "100"), ("100.0", "100"), ("0.1E+3", "100"), ("-0", "0"), ("-0.0e5", "0"), ("1.50", "1.5"), ("150e-2", "1.5"), ("-12.050", "-12.05"), ("1e-7", "1e-7"),
           ("0.0000001", "1e-7"), ("1e-6", "0.000001"), ("10000000000000000000000", "1e22"), ("1e22", "1e22"), ("12345678901234567890.10", "12345678901234567890.1"), ("1.2345678901234567890123e22", "1.2345678901234567890123e22")]


def test_equal_values_have_one_text(spark):
    from decimal import Decimal

    rows = [(f'{{"z": [{n}, "{n}"], "a": {{"b": {n}}}}}', f'{{"a":{{"b":{c}}},"z":[{c},"{n}"]}}') for n, c in NUMBERS]
    rows += [('["n1","s",{"":null}]', '["n1","s",{"":null}]'), ('{"b":1,"a":"x\\"y\\\\"}', '{"a":"x\\"y\\\\","b":1}'), ('{"a":1,"a":2}', None), ("{", None), (None, None), ('"' + "\\n" * 50_000 + '"', '"' + "\\n" * 50_000 + '"')]
    got = spark.createDataFrame(rows, "text string, want string").select("want", chat.canonical_json(F.col("text")).alias("got")).collect()
    assert all(r.got == r.want for r in got)
    assert all(Decimal(n) == Decimal(c) for n, c in NUMBERS)
    assert all(chat._python_number(float(n)) == c for n, c in NUMBERS if len(n) < 16)


def test_schemas_compare_types_and_values_at_any_depth(spark):
    schema = {"get": {
        "required": ["q"],
        "properties": {
            "q": {"enum": [True, "true", 5, None, [1, 2.0]]},
            "n": {"type": "integer", "minimum": 0},
            "deep": {"type": "object", "required": ["k"], "properties": {"k": {"type": "string", "maxLength": 3}, "l": {"type": "array", "items": {"type": "object", "properties": {"x": {"type": "number"}}, "additionalProperties": False}}}},
        },
        "additionalProperties": False,
    }}
    cases = [
        ('{"q":true}', None), ('{"q":"true"}', None), ('{"q":5.0}', None), ('{"q":[1e0,2]}', None), ('{"q":"5"}', "q is not allowed"), ('{"q":false}', "q is not allowed"), ('{"q":null}', "missing q"), ("{}", "missing q"),
        ('{"q":5,"n":10.0}', None), ('{"q":5,"n":1e3}', None), ('{"q":5,"n":1.5}', "n is no integer"), ('{"q":5,"n":"1"}', "n is no integer"), ('{"q":5,"n":-1}', "n is too small"), ('{"q":5,"n":null}', None),
        ('{"q":5,"deep":{"k":"abc","l":[{"x":1},{"x":2.5}]}}', None), ('{"q":5,"deep":[1]}', "deep is no object"), ('{"q":5,"deep":{}}', "missing deep.k"), ('{"q":5,"deep":{"k":"abcd"}}', "deep.k is too long"),
        ('{"q":5,"deep":{"k":"a","l":[{"x":1},{"x":"2"}]}}', "an item of deep.l.x is no number"), ('{"q":5,"deep":{"k":"a","l":[{"y":1}]}}', "an unknown field in an item of deep.l"), ('{"q":5,"deep":{"k":"a","l":[7]}}', "an item of deep.l is no object"),
        ('{"q":5,"z":1}', "an unknown field"), ('{"q":5,"q":6}', "a repeated key"), ('{"q":5,"deep":{"k":"a","k":"b"}}', "a repeated key"), ("[1]", "arguments are no object"), ('{"q":', "arguments are no object"), (None, "arguments are no object"),
    ]
    got = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(cases)], "k int, a string").select("k", chat.invalid_reason(F.lit("get"), F.col("a"), schema).alias("r")).collect()
    assert {r.k: r.r for r in got} == {k: want for k, (_, want) in enumerate(cases)}


def test_calls_with_several_needs_settle_in_few_rounds(spark, monkeypatch):
    n = 200
    rows = [(1, k, "assistant", _call(f"c{k}", [f"c{x}" for x in (k - 1, k - 2) if x >= 0])) for k in range(1, n)] + [(1, n, "assistant", _call("c0", []))]
    rows += [(2, n - k, "assistant", _call(f"{side}{k}", [f"{s}{k - 1}" for s in "ab"] if k else [])) for k in range(n // 2) for side in "ab"]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    saves = []
    monkeypatch.setattr(chat.Scratch, "save", lambda self, df, _save=chat.Scratch.save: saves.append(1) or _save(self, df))
    got = {(r.conv_id, r.event_id): (r.order_turn, r.order_level, r.cyclic) for r in chat.link_calls(chat.embedded_events(m), {"get": {}}).collect()}
    assert all(got[1, f"c{k}"] == (n, k, False) for k in range(n)) and all(got[2, f"{s}{k}"] == (n, k, False) for k in range(n // 2) for s in "ab")
    assert len(saves) < 45


def test_columns_of_any_name_and_arguments_as_strings(spark):
    rows = [(1, 0, "assistant", '{"tool_call":{"id":7,"name":"get","arguments":"{\\"n\\": 1e1}","needs":[]}}', "x", "y", 1, "z"), (1, 1, "tool", '{"tool_result":{"id":7.0}}', "x", "y", 1, "z")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tool string, arguments string, needs int, call_id string")
    got = {r.kind: r for r in chat.link_calls(chat.embedded_events(m), {"get": {"properties": {"n": {"type": "integer"}}}}).collect()}
    assert got["call"].link == "linked" and got["call"].invalid is None and '"arguments":{"n":10}' in got["call"].json
    assert chat.link_calls(chat.reply_events(m), REPLY_SCHEMA).count() == 2 and chat.link_calls(chat.embedded_events(m.limit(0)), {}).count() == 0


def test_messages_of_any_kind(spark):
    rows = [(1, 0, "user", "hi", "x"), (1, 0, "user", "hi", "x"), (1, 1, "assistant", None, "x"), (None, None, None, None, None), (2, None, "user", "", "x"), (3, 1, "assistant", "z" * 200_000, "x")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, json string")
    got = chat.link_calls(chat.reply_events(m), {"reply": {}}).collect()
    assert sorted((str(r.conv_id), str(r.turn), r.kind, r.link) for r in got) == [
        ("1", "0", "call", "linked"), ("1", "0", "call", "linked"), ("1", "1", "result", "linked"), ("2", "None", "message", None), ("3", "1", "result", "orphan"), ("None", "None", "message", None),
    ]
    assert all(r.json.startswith('{"arguments":') for r in got) and max(len(r.json) for r in got) > 200_000
    assert chat.link_calls(chat.reply_events(m.limit(0)), {"reply": {}}).count() == 0
