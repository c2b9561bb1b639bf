"""Conversation structure repair: the cheapest edits that make a dialogue of each conversation, by an auction for shortest paths.

Edits are arcs of a lattice: node (i, s) says that ``i`` rows are done and what
was last said (nothing, system, user, assistant).  Keep costs 0, another role 1,
deletion 2 (the only edit of blank and duplicate rows), an inserted empty turn
5; a truncated row that stays adds 5.

Auction (forward, with node prices): a path grows from its origin.  At its end
node the least of arc cost plus price of the arc's head is taken: if the node's
own price is below it, the price rises to it and the path is cut back by one
node (contraction); else the path goes on to the head that attains it
(extension), until it reaches the exit.  Prices never exceed the true cost to
the exit, so an arc is tight (price = cost + price of its head) if and only if
it can lie on a cheapest path, as far as the exit can be reached by such arcs.
The lattice is settled in stretches of ``STRETCH`` rows from the last to the
first; the entries of one, four origins in turn, have true prices then, and are
the exits of the one before.  So the work grows linearly with the rows.

Then tight arcs are followed from the first node, each time the one with the
least initial in ASCII (D, I, K, R) whose head reaches the exit by tight arcs.
No two cheapest paths to one node have audits of which one begins the other (it
would have more insertions), so that audit is the least of all.

A task streams its conversations, sorted, and holds one at a time, as it would
hold one long text; conversations that share rows or words never meet.

Defined results: a null role or text, and a null conv_id or turn in the damage
key, is one space; rows of a null conv_id are one conversation; turns are
ordered null first, equal turns by role and text; repeated rows are rows each; a
role that is empty has no initial and cannot be kept; columns other than
conv_id, turn, role and text are ignored, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
STRETCH = 16  #: rows of a stretch

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: What may be said after each state: the initial and the state it leads to.
GRAMMAR = {NOTHING: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: The turn that can be inserted, or that a row's role can become, in each state.
NEXT = {NOTHING: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
ACCEPTED = (NOTHING, ASSISTANT)
FAR = 1 << 60

#: Faults of a row; the first that holds counts.
BLANK, DUPLICATE, CUT, FINE = range(4)
_LAST = re.compile(r"[^ \t\n\v\f\r][ \t\n\v\f\r]*\Z")
_LEGAL = {"su", "ua", "au"}


def damaged(conversations: DataFrame, rate: int = 20) -> DataFrame:
    """Rows with faults put in by crc32 of ``conv_id:turn`` modulo ``rate``, and how many ``copies`` of each there are then.

    0 drops a row, 1 empties its text, 2 removes ``.!?``, 3 repeats it, 4 makes its role user.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))
    fault = F.crc32(key.cast("binary")) % rate
    return (
        conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), spaced("role").alias("was_role"), spaced("text").alias("was_text"), fault.alias("fault"))
        .withColumn("role", F.when(F.col("fault") == 4, "user").otherwise(F.col("was_role")))
        .withColumn("text", F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("was_text", "[.!?]", "")).otherwise(F.col("was_text")))
        .withColumn("copies", F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1))
    )


def faults(rows: list[tuple[str, str]]) -> list[int]:
    """The first fault of each (role, text)."""
    seen: set[bytes] = set()
    out = []
    for role, text in rows:
        last = _LAST.search(text)
        name = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        out.append(BLANK if last is None else DUPLICATE if name in seen else CUT if text[last.start()] not in ".!?" else FINE)
        seen.add(name)
    return out


def arcs(initial: str, fault: int, state: int) -> list[tuple[str, int, int, int]]:
    """(edit's initial, cost, rows done by it, next state) of the arcs of a row from ``state``, in ASCII order of the initials."""
    to, _ = NEXT[state]
    out = [("D", DELETE, 1, state), ("I", INSERT, 0, to)]
    if fault in (CUT, FINE):
        extra = TRUNCATED if fault == CUT else 0
        if initial in GRAMMAR[state]:
            out.append(("K", extra, 1, GRAMMAR[state][initial]))
        out.append(("R", REROLE + extra, 1, to))
    return out


def _settle(out_of: list[list[tuple[str, int, int, int]]], exits: list[int], least: list[int]) -> list[int]:
    """Prices of the nodes of a stretch, 4 a row and the exits behind them, after an auction from each entry.

    ``out_of``: arcs of each node; ``least``: the least cost of each row's edits,
    by which the first prices are lower bounds of the true costs.
    """
    rows = len(least)
    prices = [0] * (4 * rows) + exits
    low = min(exits)
    for i in range(rows - 1, -1, -1):
        low += least[i]
        prices[4 * i : 4 * i + 4] = [low] * 4
    end = 4 * rows
    for origin in range(4):
        path = [origin]
        while path[-1] < end:
            node = path[-1]
            at, best, head = node & ~3, FAR, -1
            for _, cost, done, state in out_of[node]:
                to = at + 4 * done + state
                if (total := cost + prices[to]) < best:
                    best, head = total, to
            if prices[node] < best:
                prices[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(head)
    return prices


def _closing(states: tuple[int, ...] = ACCEPTED) -> list[int]:
    """Costs from each state behind the last row to an accepted one, by insertions."""
    out = []
    for state in range(4):
        cost = 0
        while state not in states:
            state, cost = NEXT[state][0], cost + INSERT
        out.append(cost)
    return out


def audit(initials: list[str], found: list[int]) -> tuple[int, str]:
    """Cost and initials of the cheapest edits, ties by least ASCII."""
    n = len(initials)
    # For each row and state, the tight arc to follow; kept as one character.
    follow: list[str] = [""] * (4 * n)
    exits = _closing()
    known: dict[tuple[str, int], tuple[list, int]] = {}
    for a in reversed(range(0, n, STRETCH)):
        rows = range(a, min(n, a + STRETCH))
        out_of, least = [], []
        for i in rows:
            kind = (initials[i], found[i])
            if kind not in known:
                each = [arcs(*kind, s) for s in range(4)]
                known[kind] = each, min(x[1] for own in each for x in own if x[2])
            out_of += known[kind][0]
            least.append(known[kind][1])
        prices = _settle(out_of, exits, least)
        reaches = [False] * (4 * len(rows)) + [True] * 4
        for k in range(len(rows) - 1, -1, -1):
            for _ in range(3):  # heads of insertions lie in the same row; two of them in a line at most are tight
                for state in range(4):
                    node = 4 * k + state
                    if not reaches[node]:
                        for initial, cost, done, to in out_of[node]:
                            head = 4 * (k + done) + to
                            if reaches[head] and prices[node] == cost + prices[head]:
                                reaches[node] = True
                                break
            for state in range(4):
                node = 4 * k + state
                for initial, cost, done, to in out_of[node]:
                    head = 4 * (k + done) + to
                    if reaches[head] and prices[node] == cost + prices[head]:
                        follow[4 * (a + k) + state] = initial
                        break
        exits = prices[:4]
    said, i, state = [], 0, NOTHING
    while i < n:
        edit = follow[4 * i + state]
        said.append(edit)
        if edit == "K":
            state = GRAMMAR[state][initials[i]]
        elif edit != "D":
            state = NEXT[state][0]
        i += edit != "I"
    while state not in ACCEPTED:
        said.append("I")
        state = NEXT[state][0]
    return exits[NOTHING], "".join(said)


def repaired(rows: list[tuple[str, str]], edits: str) -> Iterator[tuple[str, str]]:
    """The rows (role, text) after the edits."""
    i, state = 0, NOTHING
    for edit in edits:
        role, text = ("", "") if edit == "I" else rows[i]
        if edit == "K":
            yield role, text
            state = GRAMMAR[state][role[0]]
        elif edit != "D":
            state, new = NEXT[state]
            yield new, text
        i += edit != "I"


def repair_one(turns: list[int | None], rows: list[tuple[str, str]]) -> dict:
    """What is wrong with a conversation's rows, in order, and its repair."""
    found = faults(rows)
    initials = [role[:1] for role, _ in rows]
    cost, edits = audit(initials, found)
    given = {t for t in turns if t is not None}
    sha = hashlib.sha256()
    for k, (role, text) in enumerate(repaired(rows, edits)):
        sha.update(f"{chr(10) if k else ''}{role}:{text}".encode())
    return {
        "gaps": max(given) - min(given) + 1 - len(given) if given else 0, "blank": found.count(BLANK), "duplicate": found.count(DUPLICATE), "truncated": found.count(CUT),
        "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False)), "cost": cost, "audit": edits, "repaired_sha256": sha.hexdigest(),
    }


def _by_conversation(rows: DataFrame, per: Callable[[int | None, list[int | None], list[tuple[str, str]]], list[dict]], schema: str, fields: pa.Schema) -> DataFrame:
    """``per`` over each conversation's turns and rows; rows of ``damaged`` are sorted in their partitions and streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        turns: list = []
        own: list = []
        out: list[dict] = []
        for batch in batches:
            for conv, turn, role, text, copies in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if now is not None and now != (conv,):
                    out += per(now[0], turns, own)
                    turns, own = [], []
                    if len(out) >= 1024:
                        yield pa.RecordBatch.from_pylist(out, fields)
                        out = []
                now = (conv,)
                turns += [turn] * copies
                own += [(role, text)] * copies
        if now is not None:
            out += per(now[0], turns, own)
            yield pa.RecordBatch.from_pylist(out, fields)

    small_batches(rows.sparkSession)
    placed = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "was_role", "was_text")
    return placed.select("conv_id", "turn", "role", "text", "copies").mapInArrow(run, schema)


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(conversations: DataFrame) -> DataFrame:
    """Per conversation after damage: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    fields = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    schema = f"conv_id long, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired_sha256 string"
    return _by_conversation(damaged(conversations), lambda conv, turns, rows: [{"conv_id": conv} | repair_one(turns, rows)], schema, fields)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text) of the repaired conversations; ``rows`` has conv_id, turn, role and text, and is taken as it is."""

    def per(conv: int | None, turns: list[int | None], own: list[tuple[str, str]]) -> list[dict]:
        _, edits = audit([r[:1] for r, _ in own], faults(own))
        return [{"conv_id": conv, "place": k, "role": role, "text": text} for k, (role, text) in enumerate(repaired(own, edits))]

    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"))
    plain = plain.withColumns({"was_role": F.col("role"), "was_text": F.col("text"), "copies": F.lit(1)})
    fields = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    return _by_conversation(plain, per, "conv_id long, place long, role string, text string", fields)
