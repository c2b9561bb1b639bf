"""Clock alignment of two series by cross-correlation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_ACTIVE_BINS = 3
MEANINGFUL_SCORE = 0.05
CONFIDENT_SCORE = 0.6


def binned(df: DataFrame, keys: Sequence[str], time: Column, size: float, bins: int, value: Column | None = None) -> DataFrame:
    """The bins of a histogram that are not zero (keys, bin, level)."""
    spot = F.greatest(F.lit(0), F.least(F.lit(bins - 1), (time / size).cast("long"))).cast("long")
    what = F.count("*").cast("double") if value is None else F.avg(value)
    return df.groupBy(*keys, spot.alias("bin")).agg(what.alias("level")).filter("level <> 0")


def timeline_offset(first: DataFrame, second: DataFrame, keys: Sequence[str], size: float, bins: int, reach: int, second_value: Column | None = None, time: str = "t") -> DataFrame:
    """Lag (in bins) at which the binned ``second`` follows ``first`` best, within ``reach`` bins either way.

    Returns keys, lag, offset (lag * size), score (correlation per bin, 0 at
    least), active_first, active_second.  Fewer than three active bins on either
    side give lag 0 and score 0.  Of equal sums the smallest lag wins.

    Only bins that are not zero meet.  The sum of z-scores over the bins that
    overlap at a lag is that of the products of levels, less the means times
    the overlapping sums, plus the product of means for each bin; the sums of
    the parts that do not overlap come from the ``reach`` bins at the ends.
    """
    a, c = binned(first, keys, F.col(time), size, bins), binned(second, keys, F.col(time), size, bins, second_value)

    def stats(df: DataFrame, n: str) -> DataFrame:
        mean = F.sum("level") / bins
        var = F.greatest(F.sum(F.col("level") * F.col("level")) / bins - mean * mean, F.lit(0.0))
        ends = F.when((F.col("bin") < reach) | (F.col("bin") >= bins - reach), F.struct("bin", "level"))
        return df.groupBy(*keys).agg(F.count_if(F.col("level") > 0).alias(f"active_{n}"), F.sum("level").alias(f"total_{n}"), mean.alias(f"mean_{n}"), F.sqrt(var).alias(f"dev_{n}"), F.collect_list(ends).alias(f"ends_{n}"))

    spread = a.select(*keys, "bin", F.col("level").alias("la")).withColumn("lag", F.explode(F.sequence(F.lit(-reach).cast("long"), F.lit(reach).cast("long")))).withColumn("bin", F.col("bin") + F.col("lag"))
    products = spread.join(c.select(*keys, "bin", F.col("level").alias("lc")), [*keys, "bin"]).groupBy(*keys, "lag").agg(F.sum(F.col("la") * F.col("lc")).alias("product"))
    maps = products.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("lag", "product"))).alias("products"))
    sa, sc = stats(a, "first"), stats(c, "second")
    both = sa.join(sc, list(keys)) if keys else sa.crossJoin(F.broadcast(sc))
    both = both.join(maps, list(keys), "left") if keys else both.crossJoin(F.broadcast(maps))
    outside = lambda ends, cond: F.aggregate(F.filter(ends, cond), F.lit(0.0), lambda s, x: s + x["level"])

    def total(lag: Column) -> Column:
        # Bins i of the first side with 0 <= i < bins and 0 <= i + lag < bins, and i + lag of the second.
        over_a = F.col("total_first") - outside("ends_first", lambda x: (x["bin"] + lag < 0) | (x["bin"] + lag >= bins))
        over_c = F.col("total_second") - outside("ends_second", lambda x: (x["bin"] - lag < 0) | (x["bin"] - lag >= bins))
        n = F.greatest(F.lit(0), bins - F.abs(lag))
        product = F.coalesce(F.try_element_at("products", lag), F.lit(0.0))
        return product - F.col("mean_second") * over_a - F.col("mean_first") * over_c + n * F.col("mean_first") * F.col("mean_second")

    flat = (F.col("dev_first") <= 1e-9) | (F.col("dev_second") <= 1e-9)
    scale = F.col("dev_first") * F.col("dev_second")
    each = F.transform(F.sequence(F.lit(-reach).cast("long"), F.lit(reach).cast("long")), lambda lag: F.struct(F.when(flat, 0.0).otherwise(F.round(F.try_divide(total(lag), scale), 9)).alias("sum"), (-lag).alias("back")))
    best = both.withColumn("best", F.array_max(each))
    enough = (F.col("active_first") >= LEAST_ACTIVE_BINS) & (F.col("active_second") >= LEAST_ACTIVE_BINS)
    lag = F.when(enough, -F.col("best.back")).otherwise(F.lit(0).cast("long"))
    return best.select(*keys, lag.alias("lag"), (lag * float(size)).alias("offset"), F.when(enough, F.greatest(F.lit(0.0), F.col("best.sum") / bins)).otherwise(0.0).alias("score"), "active_first", "active_second")


def probe(messages: DataFrame, series: DataFrame, keys: Sequence[str], start: float, duration: float, search: float, size: float = 1.0) -> DataFrame:
    """``timeline_offset`` of a bounded part: messages up to ``search`` around [start, start + duration) of the series."""
    bins = max(1, int((duration + 2 * search) / size))
    shift = F.col("t") - (start - search)
    near = messages.filter(F.col("t").between(start - search, start + duration + search)).withColumn("t", shift)
    part = series.filter((F.col("t") >= start) & (F.col("t") < start + duration)).withColumn("t", shift)
    return timeline_offset(near, part, keys, size, bins, int(search / size + 1e-9), F.col("value"))


def warning(offset: Column, score: Column, tolerance: float) -> Column:
    """What to tell about a measured offset; null if it is within tolerance or says nothing."""
    return F.when((score >= MEANINGFUL_SCORE) & (F.abs(offset) > tolerance + 1e-9), F.format_string("timelines differ by %+.1fs (score %.2f)", offset, score))


def sliding_correlation(wide: np.ndarray, clip: np.ndarray) -> tuple[int, float]:
    """Best place of ``clip`` within ``wide`` and its normalised correlation; (0, 0.0) if it has none.

    ``wide`` is centred as a whole; parts of it are not centred again.
    """
    n = len(clip)
    if n == 0 or n > len(wide):
        return 0, 0.0
    c, w = clip - clip.mean(), wide - wide.mean()
    norm = float(np.sqrt(c @ c))
    if norm <= 1e-9:
        return 0, 0.0
    size = 1 << int(np.ceil(np.log2(len(w) + n)))
    dots = np.fft.irfft(np.fft.rfft(w, size) * np.conj(np.fft.rfft(c, size)), size)[: len(w) - n + 1]
    power = np.concatenate([[0.0], np.cumsum(w * w)])
    norms = np.sqrt(np.maximum(power[n:] - power[:-n], 0.0))
    scores = np.where(norms > 1e-9, dots / (norm * np.maximum(norms, 1e-9)), 0.0)
    best = int(np.argmax(np.round(scores, 9)))
    return (best, float(scores[best])) if scores[best] > 0 else (0, 0.0)


def clip_offsets(pairs: DataFrame, frame: float = 0.05) -> DataFrame:
    """Per row (clip_id, wide array, clip array, wide_start, clip_start): lag, score and offset in seconds."""

    def run(batches):
        for frame_ in batches:
            found = [sliding_correlation(np.asarray(w, float), np.asarray(c, float)) for w, c in zip(frame_["wide"], frame_["clip"], strict=True)]
            lag = np.array([f[0] for f in found], np.int64)
            yield pd.DataFrame({"clip_id": frame_["clip_id"], "lag": lag, "score": [f[1] for f in found], "offset": lag * frame + frame_["wide_start"] - frame_["clip_start"]})

    return pairs.select("clip_id", "wide", "clip", "wide_start", "clip_start").mapInPandas(run, f"clip_id {pairs.schema['clip_id'].dataType.simpleString()}, lag long, score double, offset double")


def verified_offset(offsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median offset of confident clips, the mean score of all, and how many were checked; 0 with the best score if none is confident."""
    sure = F.col("score") >= CONFIDENT_SCORE
    out = offsets.groupBy(*keys).agg(F.median(F.when(sure, F.col("offset"))).alias("offset"), F.avg("score").alias("mean"), F.max("score").alias("best"), F.count("*").alias("checked"), F.count_if(sure).alias("confident"))
    score = F.when(F.col("confident") > 0, F.col("mean")).otherwise(F.col("best"))
    return out.select(*keys, F.coalesce("offset", F.lit(0.0)).alias("offset"), score.alias("score"), "checked", "confident", ((F.col("checked") > 0) & (score >= CONFIDENT_SCORE)).alias("is_confident"))
