"""Analytics of messages and words: context of a moment, repeats, hashtags, emphasis, cues."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import Cues
from tidemark.functions import text as tx
from tidemark.operators.blocks import runs
from tidemark.operators.sequences import islands


def keyword_hits(messages: DataFrame, keywords: Sequence[str], text: str = "text") -> DataFrame:
    """Messages with the first keyword they hold (``keyword``)."""
    return messages.withColumn("keyword", tx.first_keyword(F.col(text), [k.lower() for k in keywords])).filter("keyword is not null")


def repeated_texts(messages: DataFrame, keys: Sequence[str], top: int = 5, seq: str = "seq", text: str = "text") -> DataFrame:
    """Of the ``top`` most frequent stripped, lower-cased texts per key (first seen first among equals), those met twice or more."""
    norm = F.lower(F.trim(text))
    counts = messages.filter(F.trim(text) != "").groupBy(*keys, norm.alias("text")).agg(F.count("*").alias("n"), F.min(seq).alias("first_seq"))
    if keys:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "first_seq"))
        return counts.withColumn("rank", rank).filter((F.col("rank") <= top) & (F.col("n") >= 2)).drop("rank")
    return counts.orderBy(F.desc("n"), "first_seq").limit(top).filter("n >= 2")


def context(moments: DataFrame, messages: DataFrame, keywords: Sequence[str], cap: int = 40, before: int = 30_000_000, after: int = 30_000_000) -> dict[str, DataFrame]:
    """What was said around moments (moment_id, stream_id, us); messages are (stream_id, us, seq, user, text).

    ``messages``: per moment at most ``cap``, keywords first, then the nearest
    to the middle; emote-only ones are left out unless they hold a keyword.
    ``repeated``: texts met twice or more.  ``counts``: window_count (blanks
    included), shown and keyword_hits.
    """
    bucket = max(before, after, 1)
    keyword = tx.first_keyword(F.col("text"), [k.lower() for k in keywords])
    said = F.trim("text") != ""
    # 0: holds a keyword, 1: says something, 2: is counted only.
    rank = F.when(said & keyword.isNotNull(), 0).when(said & ~tx.is_emote_only(F.col("text")), 1).otherwise(2)
    spoken = messages.withColumns({"keyword": keyword, "_rank": rank}).filter("_rank < 2")
    shown = _around(moments, spoken, cap, before, after).select("stream_id", "moment_id", F.inline("shown"))
    around = _around(moments, messages.select("stream_id", "us", rank.alias("_rank")), 0, before, after)
    sums = around.groupBy("moment_id").agg(*(F.sum(c).alias(c) for c in ("n", "spoken", "with_keyword")))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    most = lambda c: F.least(zero(F.col(c)), F.lit(cap).cast("long"))
    counts = moments.select("moment_id").join(sums, "moment_id", "left").select("moment_id", zero(F.col("n")).alias("window_count"), most("spoken").alias("shown"), most("with_keyword").alias("keyword_hits"))
    want = moments.select("moment_id", "stream_id", F.col("us").alias("at")).withColumn("bucket", F.explode(F.sequence(F.floor((F.col("at") - before) / bucket), F.floor((F.col("at") + after) / bucket))))
    have = messages.withColumn("bucket", F.floor(F.col("us") / bucket))
    inside = want.join(have, ["stream_id", "bucket"]).filter(F.col("us").between(F.col("at") - before, F.col("at") + after)).drop("bucket")
    return {"messages": shown, "repeated": repeated_texts(inside, ["moment_id"]), "counts": counts}


def _nearest(times: np.ndarray, at: np.ndarray, middle: np.ndarray, cap: int, before: int, after: int) -> np.ndarray:
    """For each moment the places of the ``cap`` nearest of sorted times on either side of its middle, -1 where there are none in its window."""
    turned = np.lexsort((-np.arange(len(times)), times))  # backwards, the first of one instant comes first
    low, high = np.searchsorted(times, at - before), np.searchsorted(times, at + after, "right")
    split = np.clip(np.searchsorted(times, middle), low, high)[:, None]
    left, right = split - 1 - np.arange(cap), split + np.arange(cap)
    if not len(times):
        return np.full((len(at), 2 * cap), -1)
    return np.hstack([np.where(left >= low[:, None], turned[np.maximum(left, 0)], -1), np.where(right < high[:, None], np.minimum(right, len(times) - 1), -1)])


def _chosen(times: np.ndarray, rank: np.ndarray, at: np.ndarray, cap: int, before: int, after: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows to show at each moment, one after the other, and how many each has: keywords first, then the nearest to the middle, then in order."""
    middle = at + (after - before) / 2
    own = [np.flatnonzero(rank == k) for k in (0, 1)]
    found = [_nearest(times[rows], at, middle, cap, before, after) for rows in own]
    places = np.hstack([np.where(near >= 0, np.append(rows, -1)[near], -1) for rows, near in zip(own, found, strict=True)])
    behind = np.repeat([[0, 1]], 2 * cap, axis=1).reshape(1, -1) + 2 * (places < 0)
    order = np.lexsort((places, np.abs(times[places] - middle[:, None]), behind), axis=1)[:, :cap]
    best = np.take_along_axis(places, order, axis=1)
    return best[best >= 0], (best >= 0).sum(axis=1)


def _around(moments: DataFrame, messages: DataFrame, cap: int, before: int, after: int) -> DataFrame:
    """Moments with the messages (stream_id, us, _rank, ...) within their windows: how many (``n``), how many of rank 0 and 1 (``spoken``)
    and of rank 0 (``with_keyword``), and the ``cap`` to show (``shown``, without a cap none).

    Streams are cut into parts of 16 windows, each also sees what its moments
    reach.  A part is streamed in order, and counts and nearest messages are
    looked up in sorted times: a task holds about two windows, and time grows
    with the messages and the moments, not with their pairs.
    """
    size = 16 * max(before + after, 1)
    carried = [c for c in messages.columns if c not in ("stream_id", "_rank")] if cap else []
    types = {f.name: f.dataType.simpleString() for f in messages.schema.fields}
    order = [c for c in ("seq",) if c in messages.columns]
    have = messages.filter("stream_id IS NOT NULL").withColumn("_part", F.explode(F.sequence(F.floor((F.col("us") - after) / size), F.floor((F.col("us") + before) / size))))
    want = moments.filter("stream_id IS NOT NULL AND us IS NOT NULL").select("moment_id", "stream_id", "us", F.floor(F.col("us") / size).alias("_part"), F.lit(-1).alias("_rank"))
    laid = have.unionByName(want, allowMissingColumns=True).repartition("stream_id", "_part").sortWithinPartitions("stream_id", "_part", "us", *order)

    def settled(table: pa.Table, done: np.ndarray) -> pa.RecordBatch:
        """The moments ``done`` (places in the table) with what is around them."""
        times, rank = (table.column(c).to_numpy().astype(np.int64) for c in ("us", "_rank"))
        at, counts = times[done], []
        for most in (2, 1, 0):
            own = times[(rank >= 0) & (rank <= most)]
            counts.append(pa.array(np.searchsorted(own, at + after, "right") - np.searchsorted(own, at - before), pa.int64()))
        columns = [table.column(c).take(pa.array(done)).combine_chunks() for c in ("moment_id", "stream_id")] + counts
        if cap:
            rows = np.flatnonzero(rank >= 0)
            found, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k in range(0, len(at), 4096):
                some, n = _chosen(times[rows], rank[rows], at[k : k + 4096], cap, before, after) if len(rows) else (np.zeros(0, np.int64), np.zeros(len(at[k : k + 4096]), np.int64))
                found.append(some)
                sizes.append(n)
            taken = table.select(carried).take(pa.array(rows[np.concatenate(found)] if len(rows) else np.zeros(0, np.int64))).combine_chunks()
            flat = [c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in taken.columns]
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(flat, names=carried)))
        names = ["moment_id", "stream_id", "n", "spoken", "with_keyword", "shown"][: len(columns)]
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def passed(parts: list[pa.RecordBatch], last: bool) -> tuple[list[pa.RecordBatch], pa.RecordBatch | None]:
        """What later moments need of a part's rows so far, and the moments that nothing behind them can change."""
        table = pa.Table.from_batches(parts)
        times, moment = table.column("us").to_numpy(), table.column("_rank").to_numpy() < 0
        ready = moment & (last | (times + after < times[-1]))
        out = settled(table, np.flatnonzero(ready)) if ready.any() else None
        waiting = times[moment & ~ready]
        start = np.searchsorted(times, (waiting[0] if len(waiting) else times[-1]) - before)
        rest = table.slice(int(start))
        drop = ready[int(start) :]
        return [] if last else rest.filter(pa.array(~drop)).combine_chunks().to_batches(), out

    def run(batches):
        key, parts, fresh = None, [], 0
        for batch in batches:
            for own, rows in runs(batch, ["stream_id", "_part"]) if batch.num_rows else ():
                if own != key:
                    if parts and (out := passed(parts, True)[1]) is not None:
                        yield out
                    key, parts, fresh = own, [], 0
                parts.append(rows)
                fresh += rows.num_rows
                if 2 * fresh >= sum(p.num_rows for p in parts):
                    parts, out = passed(parts, False)
                    fresh = 0
                    if out is not None:
                        yield out
        if parts and (out := passed(parts, True)[1]) is not None:
            yield out

    kinds = {f.name: f.dataType.simpleString() for f in moments.schema.fields}
    shown = [f"shown array<struct<{','.join(f'`{c}`:{types[c]}' for c in carried)}>>"] if cap else []
    return laid.mapInArrow(run, ", ".join([f"moment_id {kinds['moment_id']}", f"stream_id {types['stream_id']}", "n long", "spoken long", "with_keyword long", *shown]))


def token_counts(texts: DataFrame, keys: Sequence[str], text: str = "text", least: int = 4) -> DataFrame:
    """Tokens of four characters and more that are neither stop words nor numbers, with their counts."""
    found = texts.select(*keys, F.explode(tx.tokens(F.col(text))).alias("token"))
    return found.filter((F.length("token") >= least) & ~F.col("token").isin(*tx.STOPWORDS) & ~F.col("token").rlike("^[0-9]+$")).groupBy(*keys, "token").agg(F.count("*").alias("n"))


def hashtags(texts: DataFrame, keys: Sequence[str], limit: int = 6, handle: Column | None = None, keywords: Sequence[str] = (), text: str = "text") -> DataFrame:
    """Tags per key in order: the handle, keywords the text supports, then tokens by count; (keys, place, tag)."""
    counts = token_counts(texts, keys, text).select(*keys, F.col("token").alias("tag"), F.lit(2).alias("rank"), (-F.col("n")).alias("weight"))
    all_tags = counts
    if keywords:
        listed = F.array(*(F.struct(F.lit(k).cast("long").alias("weight"), tx.hashtag(F.lit(w)).alias("tag")) for k, w in enumerate(keywords)))
        words = texts.select(*keys, F.explode(F.array_distinct(tx.tokens(F.col(text)))).alias("token")).distinct()
        support = words.select(*keys, F.explode(listed).alias("k"), "token").filter((F.col("k.tag") == F.col("token")) & (F.col("k.tag") != ""))
        all_tags = all_tags.unionByName(support.select(*keys, F.col("k.tag").alias("tag"), F.lit(1).alias("rank"), F.col("k.weight").alias("weight")))
    if handle is not None:
        own = texts.select(*keys, tx.hashtag(handle).alias("tag")).filter("tag <> ''").distinct()
        all_tags = all_tags.unionByName(own.select(*keys, "tag", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("weight")))
    best = all_tags.groupBy(*keys, "tag").agg(F.min(F.struct("rank", "weight")).alias("o"))
    if keys:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("o.rank", "o.weight", "tag"))
        return best.withColumn("place", place).filter(F.col("place") <= limit).select(*keys, "place", "tag")
    top = best.orderBy("o.rank", "o.weight", "tag").limit(limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy("o.rank", "o.weight", "tag"))).select("place", "tag")


def emphasis_words(words: DataFrame, keys: Sequence[str], keywords: Sequence[str] = (), limit: int = 12, seq: str = "seq", text: str = "text") -> DataFrame:
    """Best-scored words per key: shouted +3, digits +2, keyword +2, emotion +2, nine characters and more +1; (keys, place, word, score)."""
    core = F.regexp_replace(F.trim(text), r"""^[.,!?"'()\[\]]+|[.,!?"'()\[\]]+$""", "")
    single = [k.lower().strip(".,!?") for k in keywords if len(k.split()) == 1 and k.strip(".,!?")]
    low = F.lower("core")
    shout = (F.length("core") > 1) & F.col("core").rlike(r"\p{Lu}") & ~F.col("core").rlike(r"\p{Ll}")
    plus = lambda cond, n: F.when(cond, n).otherwise(0)
    score = plus(shout, 3) + plus(F.col("core").rlike("[0-9]"), 2) + plus(low.isin(*single) if single else F.lit(False), 2) + plus(low.isin(*tx.EMOTION_WORDS), 2) + plus(F.length("core") >= 9, 1)
    scored = words.select(*keys, seq, core.alias("core")).filter("core <> ''").select(*keys, seq, low.alias("word"), score.alias("score")).filter("score > 0")
    sums = scored.groupBy(*keys, "word").agg(F.sum("score").alias("score"), F.min(seq).alias("first"))
    if keys:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "first", "word"))
        return sums.withColumn("place", place).filter(F.col("place") <= limit).select(*keys, "place", "word", "score")
    top = sums.orderBy(F.desc("score"), "first", "word").limit(limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "first", "word"))).select("place", "word", "score")


def interpolate_words(segments: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Words of segments (start, end, text) at equal widths; (keys, seq, start, end, text)."""
    parts = segments.filter(F.trim(text) != "").select(*keys, F.col("start").alias("s"), F.col("end").alias("e"), F.split(F.trim(text), r"\s+").alias("parts"))
    each = parts.select(*keys, "s", "e", F.size("parts").alias("n"), F.posexplode("parts").alias("seq", "text"))
    width = (F.col("e") - F.col("s")) / F.col("n")
    return each.select(*keys, F.col("seq").cast("long").alias("seq"), (F.col("s") + F.col("seq") * width).alias("start"), (F.col("s") + (F.col("seq") + 1) * width).alias("end"), "text")


def transcript_words(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Own words of segments (array ``words`` of start, end, text) or, where there are none, interpolated ones; in order."""
    none = F.coalesce(F.size("words"), F.lit(-1)) <= 0
    own = segments.filter(~none).select(*keys, F.inline("words")).select(*keys, "start", "end", "text")
    made = interpolate_words(segments.filter(none), keys).select(*keys, "start", "end", "text")
    w = Window.partitionBy(*keys).orderBy("start", "end", "text")
    return own.unionByName(made).withColumn("seq", F.row_number().over(w).cast("long"))


def attach_words(segments: DataFrame, words: DataFrame, keys: Sequence[str], size: float = 30.0) -> DataFrame:
    """Each segment (segment_id, start, end, text) with the words it overlaps, a straddling word in both."""
    spread = lambda df: F.explode(F.sequence(F.floor(df["start"] / size), F.floor(df["end"] / size)))
    left = segments.select(*keys, "segment_id", F.col("start").alias("s"), F.col("end").alias("e"), spread(segments).alias("bucket"))
    right = words.select(*keys, "start", "end", "text", spread(words).alias("bucket"))
    hits = left.join(right, [*keys, "bucket"]).filter((F.col("start") < F.col("e")) & (F.col("end") > F.col("s"))).select(*keys, "segment_id", "start", "end", "text").distinct()
    own = hits.groupBy(*keys, "segment_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "text"))).alias("words"))
    return segments.join(own, [*keys, "segment_id"], "left")


def cues(words: DataFrame, keys: Sequence[str], cfg: Cues = Cues(), upper: bool = False) -> DataFrame:
    """Words (start, end, text) packed into readable cues; (keys, cue, start, end, text, words).

    A cue ends where the next word would pass the character budget or the
    longest duration, after a pause, or after a sentence.  Overlapping cues
    merge, short ones are stretched, and none passes the next one's start.
    Packing restarts at every pause and sentence, so only the words between two
    of these are folded.
    """
    budget = max(1, cfg.max_chars * cfg.max_lines)
    real = words.filter(F.trim("text") != "").select(*keys, F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), (F.upper(F.trim("text")) if upper else F.trim("text")).alias("text"))
    order = ["start", "end", "text"]
    w = Window.partitionBy(*keys).orderBy(*order)
    fresh = (F.col("start") - F.lag("end").over(w) >= cfg.pause) | tx.ends_sentence(F.lag("text").over(w))
    runs = islands(real, keys, order, fresh).groupBy(*keys, "island").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("rows"))

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        full = (last["chars"] + 1 + F.length(x["text"]) > budget) | (x["end"] - last["start"] > cfg.max_seconds)
        new = F.struct(x["start"].alias("start"), F.greatest(x["end"], x["start"]).alias("end"), F.length(x["text"]).alias("chars"), F.array(x).alias("words"))
        grown = F.struct(last["start"].alias("start"), F.greatest(x["end"], last["start"]).alias("end"), (last["chars"] + 1 + F.length(x["text"])).alias("chars"), F.concat(last["words"], F.array(x)).alias("words"))
        return F.when(F.coalesce(full, F.lit(True)), F.concat(acc, F.array(new))).otherwise(F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown)))

    word = "struct<start:double,end:double,text:string>"
    packed = runs.select(*keys, F.inline(F.aggregate("rows", F.array().cast(f"array<struct<start:double,end:double,chars:int,words:array<{word}>>>"), step)))
    # A cue that begins before its predecessor ends joins it; the end of the joined cue is that of its last word.
    before = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    merged = islands(packed, keys, ["start", "end"], F.col("start") >= F.max("end").over(before)).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max_by("end", F.struct("start", "end")).alias("end"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "words"))), lambda c: c["words"])).alias("words"))
    after = Window.partitionBy(*keys).orderBy("start", "island")
    stretched = merged.withColumn("end", F.greatest(F.col("end"), F.col("start") + cfg.min_seconds))
    limit = F.lead("start").over(after)
    return stretched.select(*keys, F.row_number().over(after).cast("long").alias("cue"), "start", F.when(limit.isNull(), F.col("end")).otherwise(F.least("end", F.greatest("start", limit))).alias("end"), F.array_join(F.transform("words", lambda x: x["text"]), " ").alias("text"), "words")


def thumbnail_time(cue_rows: DataFrame, clips: DataFrame) -> DataFrame:
    """Middle of the longest cue (the first of equals) within the clip, or of the clip; (clip_id, at)."""
    longest = cue_rows.groupBy("clip_id").agg(F.max_by((F.col("start") + F.col("end")) / 2, F.struct(F.col("end") - F.col("start"), -F.col("start"))).alias("middle"))
    return clips.join(longest, "clip_id", "left").select("clip_id", F.greatest(F.lit(0.0), F.least(F.coalesce("middle", F.col("duration") / 2), F.col("duration"))).alias("at"))
