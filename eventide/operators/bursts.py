"""Scene bursts: open on a live frame, close after grace and hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.functions.times import add_seconds
from eventide.operators import blocks
from eventide.operators.blocks import BLOCK
from eventide.params import PerceptionParams
from eventide.session import stage

KEYS = ["camera"]
ORDER = ["ts", "frame_idx"]


def _closes(ts: Column, last_live: Column, last_presence: Column, p: PerceptionParams) -> Column:
    us = F.unix_micros(ts)
    idle = us - F.unix_micros(last_live) >= blocks.micros(p.merge_grace_s)
    away = last_presence.isNull() | (us - F.unix_micros(last_presence) >= blocks.micros(p.presence_hold_s))
    return idle & away


def burst_flags(frames: DataFrame, p: PerceptionParams) -> DataFrame:
    """Adds ``last_live``, ``last_presence``, ``closes`` and ``starts`` per frame, and the block column.

    ``frames`` needs camera, ts, frame_idx, live and presence.  The grace must
    be positive: then a live frame is never idle long enough to close.
    """
    if p.merge_grace_s <= 0:
        raise ValueError("merge_grace_s must be positive")
    b = blocks.with_block(frames, p.block_s)
    before = blocks.carry(
        b,
        KEYS,
        {
            "_live0": F.max(F.when(F.col("live"), F.col("ts"))),
            "_pres0": F.max(F.when(F.col("presence"), F.col("ts"))),
            "_row0": F.max("ts"),
        },
        F.max,
    )
    w = blocks.within(KEYS, *ORDER)
    upto = blocks.so_far(w)
    flagged = (
        blocks.join_carry(b, before, KEYS)
        .withColumn("last_live", F.greatest(F.max(F.when(F.col("live"), F.col("ts"))).over(upto), "_live0"))
        .withColumn("last_presence", F.greatest(F.max(F.when(F.col("presence"), F.col("ts"))).over(upto), "_pres0"))
        .withColumn("closes", F.coalesce(
            _closes(F.col("ts"), F.col("last_live"), F.col("last_presence"), p), F.lit(False)))
    )
    closed0 = _closes(F.col("_row0"), F.col("_live0"), F.col("_pres0"), p)
    was_closed = F.coalesce(F.lag("closes").over(w), closed0, F.lit(False))
    no_live_yet = F.coalesce(F.lag("last_live").over(w), F.col("_live0")).isNull()
    return flagged.withColumn("starts", F.col("live") & (no_live_yet | was_closed)).drop("_live0", "_pres0", "_row0")


def bursts(frames: DataFrame, p: PerceptionParams) -> DataFrame:
    """One row per burst.

    Input as for :func:`burst_flags` plus motion and objects.  ``close_ts`` is
    the first frame that closes the burst; a burst still open at the end of
    input has none and is marked ``flushed``.  ``kept`` says whether it is long
    enough to be reported.
    """
    w = blocks.within(KEYS, *ORDER)
    flagged = burst_flags(frames, p).withColumn(
        "_seq", F.sum(F.col("starts").cast("int")).over(blocks.so_far(w))
    )
    live, pos = F.col("live"), F.struct("ts", "frame_idx")
    # same partitioning as the window, so this aggregation does not shuffle
    pieces = flagged.groupBy(*KEYS, BLOCK, "_seq").agg(
        F.min(pos).alias("_head"),
        F.max("ts").alias("_last_row"),
        F.max(F.when(live, F.col("ts"))).alias("_last_live"),
        F.max(F.when(live, F.col("motion"))).alias("_peak"),
        F.min_by("motion", pos).alias("_motion0"),
        F.min_by("objects", pos).alias("_objects0"),
        F.array_distinct(F.flatten(F.collect_set(F.when(live, F.col("objects"))))).alias("_objects"),
        F.min(F.when(F.col("closes"), F.col("ts"))).alias("_close"),
        F.count_if(live).alias("_n_live"),
    )
    pieces = stage(pieces)  # far fewer than frames, and read twice below
    begun = F.col("_seq") > 0
    owned = blocks.stitch(pieces, KEYS, "_burst")
    first = lambda c: F.max(F.when(begun, F.col(c)))  # noqa: E731  one begun piece per burst
    whole = owned.groupBy(*KEYS, "_burst").agg(
        F.max("_last_live").alias("last_live_ts"),
        F.max("_last_row").alias("last_row_ts"),
        F.min("_close").alias("close_ts"),
        F.max("_peak").alias("peak_motion"),
        first("_motion0").alias("first_motion"),
        F.array_sort(first("_objects0")).alias("first_objects"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_objects")))).alias("objects"),
        F.sum("_n_live").alias("live_frames"),
    )
    start, last = F.col("_burst.ts"), F.col("last_live_ts")
    padded = F.unix_micros(add_seconds(last, p.clip_post_s)) - F.unix_micros(add_seconds(start, -p.clip_pre_s))
    return (
        whole.withColumn("start_ts", start)
        .withColumn("start_frame", F.col("_burst.frame_idx"))
        .withColumn("duration_s", F.greatest(F.lit(0.0), padded / F.lit(1e6)))
        .withColumn("flushed", F.col("close_ts").isNull())
        .withColumn("kept", F.col("duration_s") >= p.min_event_sec)
        .drop("_burst")
    )
