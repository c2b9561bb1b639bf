"""One-to-one matching of two event streams by nearness in time; nearest samples; containment."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.sequences import fill_forward, ordered_scan, sessions


class _Window:
    """Rows of the second stream that rows of the first may still take: sorted times, and for each place the next free one on either side.

    Taken places are skipped by two disjoint sets (to the left and to the
    right, with path halving), so a search does not pass over them again.
    """

    def __init__(self):
        self.times: list[int] = []
        self.rows: list[dict] = []
        self.left: list[int] = []  # the place itself while it is free, else one further to the left
        self.right: list[int] = []

    def add(self, row: dict) -> None:
        self.left.append(len(self.times))
        self.right.append(len(self.times))
        self.times.append(row["us"])
        self.rows.append(row)

    def _find(self, links: list[int], k: int) -> int:
        while 0 <= k < len(links) and links[k] != k:
            above = links[k]
            if 0 <= above < len(links):
                links[k] = links[above]
            k = links[k]
        return k

    def take(self, us: int, reach: int) -> dict | None:
        """The nearest free row within ``reach``, of equally near ones the later; it is free no more."""
        middle = bisect_right(self.times, us)
        low, high = self._find(self.left, middle - 1), self._find(self.right, middle)
        before = us - self.times[low] if low >= 0 else reach + 1
        after = self.times[high] - us if high < len(self.times) else reach + 1
        if min(before, after) > reach:
            return None
        # Of rows at one instant behind, the last free one.
        k = low if before < after else self._find(self.left, bisect_right(self.times, self.times[high]) - 1)
        self.left[k], self.right[k] = k - 1, k + 1
        return self.rows[k]

    def drop_before(self, us: int) -> list[dict]:
        """Forget the rows before ``us``; those that nobody took."""
        return self._drop(bisect_left(self.times, us))

    def drop_all(self) -> list[dict]:
        return self._drop(len(self.times))

    def _drop(self, n: int) -> list[dict]:
        if not n or n < len(self.times) and 2 * n < len(self.times):  # at least half, so each row is moved a few times at most
            return []
        free = [self.rows[k] for k in range(n) if self.left[k] == k]
        self.times, self.rows = self.times[n:], self.rows[n:]
        self.left, self.right = [max(-1, k - n) for k in self.left[n:]], [k - n for k in self.right[n:]]
        return free


def fuse(
    first: DataFrame, second: DataFrame, keys: Sequence[str], proximity: int, weight: float = 0.5, at: str = "us", seq: str = "seq", score: str = "score",
    first_also: Sequence[str] = (), second_also: Sequence[str] = (), blocks: int | None = None,
) -> DataFrame:
    """Each row of ``first``, in order, takes the nearest free row of ``second`` within ``proximity``.

    Of equally near rows the later one is taken; a row is taken once; whatever
    stays alone is kept, rows without a time too; no score counts as 0 in a pair.
    Returns keys, us, kind (pair, first, second), score, first_seq, second_seq,
    second_us, and the columns ``first_also`` and ``second_also`` of either side,
    as first_<name> and second_<name>.

    Rows can only meet within a run of rows (of both sides) none of which is
    further than ``proximity`` from the next; runs are numbered in blocks and
    spread over tasks.  A run is streamed: a row of ``first`` waits until all it
    can take has passed, so a task holds the rows of two proximities, and time
    grows in proportion to the rows.
    """
    also = [(f"first_{c}", c, 0) for c in first_also] + [(f"second_{c}", c, 1) for c in second_also]

    def side(df: DataFrame, n: int) -> DataFrame:
        more = [(F.col(c) if n == of else F.lit(None).cast((first, second)[of].schema[c].dataType)).alias(name) for name, c, of in also]
        return df.select(*keys, F.col(at).cast("long").alias("us"), F.lit(n).alias("side"), F.col(seq).cast("long").alias("seq"), F.col(score).cast("double").alias("score"), *more)

    both = side(first, 0).unionByName(side(second, 1))
    together = sessions(both, keys, proximity, "us", "side", "run", blocks)
    names = [*keys, "us", "kind", "score", "first_seq", "second_seq", "second_us", *(name for name, _, _ in also)]
    fields = {f.name: f.dataType.simpleString() for f in both.schema.fields} | {"kind": "string", "first_seq": "long", "second_seq": "long", "second_us": "long"}

    def alone(row: dict) -> dict:
        own = {c: row[c] for c in names if c in row}
        if row["side"] == 0:
            return own | {"kind": "first", "first_seq": row["seq"], "second_seq": None, "second_us": None}
        return own | {"kind": "second", "first_seq": None, "second_seq": row["seq"], "second_us": row["us"]}

    def paired(row: dict, other: dict) -> dict:
        more = {name: other[name] for name, _, of in also if of == 1}
        return alone(row) | more | {"kind": "pair", "score": min(1.0, (row["score"] or 0.0) + weight * (other["score"] or 0.0)), "second_seq": other["seq"], "second_us": other["us"]}

    def settle(waiting: list[dict], window: _Window, upto: int | None) -> list[dict]:
        """Rows of ``first`` that nothing after ``upto`` can meet (None: all)."""
        out, n = [], 0
        for row in waiting:
            if upto is not None and row["us"] + proximity >= upto:
                break
            out += map(alone, window.drop_before(row["us"] - proximity))
            other = window.take(row["us"], proximity)
            out.append(alone(row) if other is None else paired(row, other))
            n += 1
        del waiting[:n]
        return out

    def batch_of(rows: list[dict], like: pa.Schema) -> pa.RecordBatch:
        types = {f.name: f.type for f in like} | {"kind": pa.string(), "first_seq": pa.int64(), "second_seq": pa.int64(), "second_us": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types[c]) for c in names], names=names)

    def step(state, rows: pa.RecordBatch):
        waiting, window, _ = state or ([], _Window(), None)
        out = []
        for row in rows.to_pylist():
            if row["us"] is None:
                out.append(alone(row))
            elif row["side"] == 0:
                waiting.append(row)
            else:
                if waiting:
                    out += settle(waiting, window, row["us"])
                window.add(row)
        if waiting:
            out += settle(waiting, window, waiting[-1]["us"])
        else:  # the run's next row of ``first`` is behind the last row here
            out += map(alone, window.drop_before((rows.column("us")[-1].as_py() or 0) - proximity))
        return (waiting, window, rows.schema), batch_of(out, rows.schema)

    def finish(state):
        waiting, window, like = state
        return batch_of(settle(waiting, window, None) + [alone(x) for x in window.drop_all()], like)

    return ordered_scan(together, [*keys, "run"], ["us", "side", "seq"], step, ", ".join(f"`{c}` {fields[c]}" for c in names), finish)


def nearest_sample(times: DataFrame, samples: DataFrame, keys: Sequence[str], at: str = "us", values: Sequence[str] = ("value",), blocks: int | None = None) -> DataFrame:
    """For each distinct time the nearest sample of its key (the earlier of equals): distance, sample_us and its ``values``.

    Times and samples are sorted together; the last sample before and the first
    one behind are carried to each time, in blocks, so a gap between samples may
    have any length.  Of samples at one instant the one with the least values
    counts.  Times of a key without samples have no row, nor have null times.
    """
    sample = F.struct(F.col("us").alias("sample_us"), *values)
    own = samples.select(*keys, F.col(at).cast("long").alias("us"), *values).filter("us IS NOT NULL").groupBy(*keys, "us").agg(F.min(F.struct(*values)).alias("v"))
    own = own.select(*keys, "us", *(F.col(f"v.{v}").alias(v) for v in values)).select(*keys, "us", sample.alias("before"))
    asked = times.select(*keys, F.col(at).cast("long").alias("us")).filter("us IS NOT NULL").distinct().withColumn("before", F.lit(None).cast(own.schema["before"].dataType))
    both = own.withColumn("asked", F.lit(False)).unionByName(asked.withColumn("asked", F.lit(True)))
    seen = fill_forward(both, keys, ["us", "asked"], ["before"], blocks)
    # Backwards: samples have themselves in both columns.
    turned = seen.withColumns({"back": -F.col("us"), "after": F.when(~F.col("asked"), F.col("before"))})
    met = fill_forward(turned, keys, ["back", "asked"], ["after"], blocks).filter("asked")
    near = F.array_min(F.filter(F.array(*(F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c)["sample_us"] - F.col("us")).alias("distance"), F.col(c)["sample_us"].alias("sample_us"), *(F.col(c)[v].alias(v) for v in values))) for c in ("before", "after"))), lambda x: x.isNotNull()))
    return met.withColumn("near", near).filter("near IS NOT NULL").select(*keys, F.col("us").alias(at), "near.distance", "near.sample_us", *(F.col(f"near.{v}").alias(v) for v in values))


def nearest_sample_within(times: DataFrame, samples: DataFrame, keys: Sequence[str], reach: int, at: str = "us", values: Sequence[str] = ("value",)) -> DataFrame:
    """As ``nearest_sample``, for samples within ``reach`` only: times without one have no row.

    Both sides are put into buckets of ``reach``; a time looks into its own and
    the two beside it, so the join is on equal keys and needs no order.
    """
    bucket = lambda c: F.floor(F.col(c) / reach)
    left = times.select(*keys, F.col(at).alias("of_us")).withColumn("bucket", F.explode(F.array(bucket("of_us") - 1, bucket("of_us"), bucket("of_us") + 1)))
    right = samples.select(*keys, F.col(at).alias("us"), *values).withColumn("bucket", bucket("us"))
    joined = left.join(right, [*keys, "bucket"]).withColumn("distance", F.abs(F.col("us") - F.col("of_us"))).filter(F.col("distance") <= reach)
    return joined.groupBy(*keys, "of_us").agg(F.min(F.struct("distance", "us", *values)).alias("best")).select(*keys, F.col("of_us").alias(at), "best.distance", F.col("best.us").alias("sample_us"), *(F.col(f"best.{v}").alias(v) for v in values))


def containing(points: DataFrame, spans: DataFrame, keys: Sequence[str], size: int, point: str = "us", closed: bool = True) -> DataFrame:
    """For each point the first span (struct ``span``: start, end) that holds it, ends included if ``closed``.

    Spans are spread over the buckets of ``size`` they touch; points look up
    one bucket.
    """
    inside = (F.col("start") <= F.col(point)) & (F.col(point) <= F.col("end")) if closed else (F.col("start") < F.col(point)) & (F.col(point) < F.col("end"))
    spread = spans.select(*keys, "start", "end", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor(F.col("end") / size))).alias("bucket"))
    found = points.withColumn("bucket", F.floor(F.col(point) / size)).join(spread, [*keys, "bucket"]).filter(inside)
    return found.groupBy(*keys, point).agg(F.min(F.struct("start", "end")).alias("span"))
