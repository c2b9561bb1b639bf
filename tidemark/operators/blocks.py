"""Ordered scans of keys that may hold any share of all rows: blocks, summaries, and a second pass with carried states.

Rows are range-partitioned by (keys, order), sorted, and kept by a reliable
checkpoint, so that blocks are the same in both passes and survive lost
executors.

1.  Each block turns the run of its last key into a summary: what the run makes
    of any state it may be entered with.
2.  The driver goes over the blocks in order: a state enters a block, its summary
    tells with which state the next block begins.  One summary is in memory at a
    time, one small state a block is kept.
3.  Each block runs over its rows once more, from the state it is entered with.

Where summaries tell states but for rounding (``Scan.exact``), the blocks that a
key runs through are run again from the states they are entered with, until each
is entered with what the one before it ends with.

So one key is scanned by as many tasks as it has blocks, and results equal those
of a single scan.
"""

from __future__ import annotations

import pickle
from collections.abc import Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import checkpointed


class Scan:
    """What an operator does with the rows of a key, in order.

    ``summary`` gets a run's rows and returns something small; ``enter`` applies a
    summary to the state a run is entered with (None: the key begins there);
    ``step`` runs over rows from a state; ``finish`` gives what is left behind a
    key's last row.  If ``exact`` is false, ``enter`` may be off by rounding where
    a run is entered with a state.
    """

    exact = True

    def summary(self, rows: pa.Table) -> Any:
        raise NotImplementedError

    def enter(self, state: Any, summary: Any) -> Any:
        raise NotImplementedError

    def step(self, state: Any, rows: pa.RecordBatch) -> tuple[Any, pa.RecordBatch | None]:
        raise NotImplementedError

    def finish(self, state: Any) -> pa.RecordBatch | None:
        return None


def runs(batch: pa.RecordBatch, keys: Sequence[str]):
    """(key, rows) for each run of one key in a batch; null equals null."""
    new = np.zeros(batch.num_rows, bool)
    for k in keys:
        column = batch.column(k)
        apart = pc.fill_null(pc.not_equal(column[1:], column[:-1]), False)
        new[1:] |= np.asarray(apart) | np.asarray(pc.xor(pc.is_null(column[1:]), pc.is_null(column[:-1])))
    edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        yield tuple(batch.column(k)[low].as_py() for k in keys), batch.slice(low, high - low)


def placed_in_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], blocks: int | None = None) -> DataFrame:
    """Rows range-partitioned and sorted by keys and order, kept as they lie."""
    columns = [*keys, *order]
    laid = df.repartitionByRange(blocks, *columns) if blocks else df.repartitionByRange(*columns)
    return checkpointed(laid.sortWithinPartitions(*columns))


def block_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], scan: Scan, schema: str | None = None, blocks: int | None = None) -> DataFrame:
    """``scan`` over the rows of each key in order, whatever share of all rows a key has."""
    keys = list(keys)
    placed = placed_in_blocks(df, keys, order, blocks)
    schema = schema or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields)
    enters, last_of = _entered(placed, keys, scan)

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId()
        key, state = None, None
        for batch in batches:
            out = []
            for own, rows in runs(batch, keys) if batch.num_rows else ():
                if key is None:
                    state = enters.get(block)
                elif own != key:
                    out.append(scan.finish(state))
                    state = None
                key = own
                state, some = scan.step(state, rows)
                out.append(some)
            out = [x for x in out if x is not None and x.num_rows]
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
        if key is not None and block in last_of and (left := scan.finish(state)) is not None and left.num_rows:
            yield left

    return placed.mapInArrow(run, schema)


def _entered(placed: DataFrame, keys: list[str], scan: Scan) -> tuple[dict[int, Any], set[int]]:
    """The state each block is entered with (where its first key goes on), and the blocks in which their last key ends."""

    def summarize(batches):
        from pyspark import TaskContext

        first, last, own = None, None, []
        for batch in batches:
            for key, rows in runs(batch, keys) if batch.num_rows else ():
                if key != last:
                    first, last, own = first or key, key, []
                own.append(rows)
        if last is not None:
            told = pickle.dumps((first, last, scan.summary(pa.Table.from_batches(own))))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([told], pa.binary())], names=["block", "told"])

    enters: dict[int, Any] = {}
    last_of: set[int] = set()
    after: dict[int, int] = {}  # blocks of one key that came in and goes on, and the block it goes on in
    key, state, before, through = None, None, None, False
    for block, told in placed.mapInArrow(summarize, "block long, told binary").orderBy("block").toLocalIterator():
        first, last, summary = pickle.loads(told)
        if first == key:
            enters[block] = state
            if through:
                after[before] = block
        elif before is not None:
            last_of.add(before)
        state = scan.enter(state if first == last == key else None, summary)
        through = first == last and block in enters
        key, before = last, block
    if before is not None:
        last_of.add(before)
    return (enters if scan.exact else _settled(placed, scan, enters, after)), last_of


def _settled(placed: DataFrame, scan: Scan, enters: dict[int, Any], after: dict[int, int]) -> dict[int, Any]:
    """``enters`` such that each block is entered with what the one before it ends with, run row by row.

    In a round, blocks run from where they are entered by what is known so far,
    side by side; the first of a key that is not settled is so after it.  Most
    forget the last bits of a start, so two rounds do; what has stood still is
    taken to stand still again, and checked in the next round.
    """
    ran: dict[int, tuple[Any, Any]] = {}
    same = lambda a, b: repr(a) == repr(b)  # noqa: E731  (NaN too)
    while stale := {b: enters[b] for b in after if b not in ran or not same(ran[b][0], enters[b])}:

        def run(batches, stale=stale):
            from pyspark import TaskContext

            block = TaskContext.get().partitionId()
            state = stale.get(block)
            for batch in batches:
                if batch.num_rows:
                    state, _ = scan.step(state, batch)
            if block in stale:
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([pickle.dumps(state)], pa.binary())], names=["block", "told"])

        own = placed.filter(F.spark_partition_id().isin(list(stale)))
        for block, told in own.mapInArrow(run, "block long, told binary").collect():
            ran[block] = (stale[block], pickle.loads(told))
        for block, following in after.items():
            start, end = ran[block]
            enters[following] = end if same(start, enters[block]) or not same(start, end) else enters[block]
    return enters
