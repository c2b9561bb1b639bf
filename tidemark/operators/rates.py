"""Anomalies against a trailing baseline: message rates, levels, binned series."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.blocks import runs
from tidemark.operators.sequences import above_trailing, thin
from tidemark.session import checkpointed


def window_counts(
    df: DataFrame, keys: Sequence[str], window: int, baseline: int, at: str = "us", seq: str = "seq", part: int | None = None,
    peers: bool = False, keep: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """At each row, the rows up to it within ``window`` and ``baseline`` before it (window_count, baseline_count).

    Of the rows of one instant, those up to the row count, or all with ``peers``,
    as in a RANGE frame.  Only rows that ``keep`` of both counts says go on.
    Rows without a time go.

    A stream is cut into parts of time (16 baselines unless ``part`` says
    otherwise); a part also sees the rows one baseline before it, so one stream
    may hold any share of all rows.  A part is streamed in order: a task holds
    the times of one baseline and, with ``peers``, the rows of one instant, and
    time grows in proportion to the rows.
    """
    size, names = max(baseline, part or 16 * baseline), df.columns
    own, upto = F.floor(F.col(at) / size), F.floor((F.col(at) + baseline) / size)
    spread = df.select("*", F.posexplode(F.sequence(own, upto)).alias("_place", "_part"))
    laid = spread.repartition(*keys, "_part").sortWithinPartitions(*keys, "_part", at, seq)

    def counted(past: np.ndarray, rows: pa.RecordBatch) -> tuple[np.ndarray, pa.RecordBatch]:
        """Rows of a part with their counts, and the times that rows behind them need; ``past`` are those before them."""
        times = np.asarray(rows.column(at)).astype(np.int64)
        whole = np.concatenate([past, times])
        upto = np.searchsorted(whole, times, "right") if peers else np.arange(len(past) + 1, len(whole) + 1)
        wc, bc = (upto - np.searchsorted(whole, times - span) for span in (window, baseline))
        mask = np.asarray(rows.column("_place")) == 0
        if keep is not None:
            mask &= keep(wc, bc)
        out = pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), pa.array(wc, pa.int64()), pa.array(bc, pa.int64())], names=[*names, "window_count", "baseline_count"])
        return whole[np.searchsorted(whole, times[-1] - baseline) :], out.filter(pa.array(mask))

    def run(batches):
        key, past, held = None, np.zeros(0, np.int64), []
        joined = lambda parts: pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        for batch in batches:
            for own, rows in runs(batch, [*keys, "_part"]) if batch.num_rows else ():
                if own != key:
                    if held:
                        yield counted(past, joined(held))[1]
                    key, past, held = own, np.zeros(0, np.int64), []
                if peers:  # the last instant may go on in the next batch
                    times = np.asarray(rows.column(at)).astype(np.int64)
                    last = int(np.searchsorted(times, times[-1]))
                    if last or held and held[-1].column(at)[0].as_py() != times[-1]:
                        past, out = counted(past, joined([*held, rows.slice(0, last)]))
                        held = []
                        yield out
                    held.append(rows.slice(last))
                else:
                    past, out = counted(past, rows)
                    yield out
        if held:
            yield counted(past, joined(held))[1]

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "window_count long", "baseline_count long"])
    return laid.mapInArrow(run, schema)


def rate_spikes(df: DataFrame, keys: Sequence[str], window: int, baseline: int, multiplier: float, min_rate: float, at: str = "us", seq: str = "seq", peers: bool = False) -> DataFrame:
    """Moments whose rate is ``multiplier`` times the baseline's and ``min_rate`` per second at least, ``window`` apart.

    With ``peers``, rows of one instant count for each other, and go on together.
    Returns keys, at, seq, window_rate, baseline_rate, ratio, window_count.
    """

    def hot(wc: np.ndarray, bc: np.ndarray) -> np.ndarray:
        wr, br = wc / (window / 1e6), bc / (baseline / 1e6)
        return (wr >= min_rate) & (br > 0) & (wr >= br * multiplier)

    wr = F.col("window_count") / F.lit(window / 1e6)
    br = F.col("baseline_count") / F.lit(baseline / 1e6)
    # Kept first: a range partitioning goes over its input twice.
    found = checkpointed(window_counts(df.select(*keys, at, seq), keys, window, baseline, at, seq, peers=peers, keep=hot))
    return thin(found.select(*keys, at, seq, wr.alias("window_rate"), br.alias("baseline_rate"), (wr / br).alias("ratio"), "window_count"), keys, window, at, seq, peers=peers)


def level_spikes(df: DataFrame, keys: Sequence[str], frames: int, multiplier: float, floor: float, refractory: int, at: str = "us", value: str = "value", seq: str = "seq", blocks: int | None = None, peers: bool = False) -> DataFrame:
    """Values ``multiplier`` times the mean of the ``frames`` before them, ``floor`` at least, ``refractory`` apart (rows of one instant not, with ``peers``).

    The first value of a key is its own baseline.  Returns keys, at, seq, value, level (the baseline).
    """
    hot = above_trailing(df.select(*keys, at, seq, value), keys, frames, multiplier, floor, at, value, seq, blocks)
    return thin(hot, keys, refractory, at, seq, peers=peers)


def rms_frames(samples: DataFrame, keys: Sequence[str], rate: int, frame: float, index: str = "idx", value: str = "value") -> DataFrame:
    """Root mean square of whole frames, at their middles; the rest is dropped.  A series shorter than a frame is one frame at 0."""
    size = max(1, int(rate * frame))
    part = F.floor(F.col(index) / size)
    square = (F.col(value).cast("double") * F.col(value).cast("double"))
    frames = samples.groupBy(*keys, part.alias("frame")).agg(F.count("*").alias("n"), F.avg(square).alias("power"))
    whole = frames.filter(F.col("n") == size).select(*keys, "frame", ((F.col("frame") + 0.5) * float(frame)).alias("t"), F.sqrt("power").alias("rms"))
    short = frames.groupBy(*keys).agg(F.sum("n").alias("all"), (F.sum(F.col("power") * F.col("n")) / F.sum("n")).alias("power")).filter(F.col("all") < size)
    return whole.unionByName(short.select(*keys, F.lit(0).cast("long").alias("frame"), F.lit(0.0).alias("t"), F.sqrt("power").alias("rms")))


def histogram(df: DataFrame, keys: Sequence[str], time: Column, size: float, bins: int, value: Column | None = None) -> DataFrame:
    """Count (or mean of ``value``) per bin, empty bins as 0; times before or after fall into the first or last bin."""
    spot = F.greatest(F.lit(0), F.least(F.lit(bins - 1), (time / size).cast("long")))
    what = F.count("*").cast("double") if value is None else F.avg(value)
    found = df.groupBy(*keys, spot.cast("long").alias("bin")).agg(what.alias("level"))
    names = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    spine = names.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    return spine.join(found, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("level", F.lit(0.0)).alias("level"))


def normalize(df: DataFrame, keys: Sequence[str], value: str = "level") -> DataFrame:
    """Z-scores with the population's deviation; a flat series is all zeros."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("dev"))
    joined = df.join(stats, list(keys)) if keys else df.crossJoin(F.broadcast(stats))
    return joined.withColumn("z", F.when(F.col("dev") <= 1e-9, F.lit(0.0)).otherwise((F.col(value) - F.col("mean")) / F.col("dev"))).drop("mean", "dev")
