"""Ordered look-ups between two row sets of one key.

Both sides are put in one sorted stream per (key, block); values from outside
the block come from the block summaries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.operators import blocks
from eventide.operators.blocks import BLOCK

KEYS = ["camera"]


def next_frame_after(probes: DataFrame, frames: DataFrame, at: str, out: str, block_s: float) -> DataFrame:
    """Adds to each probe the time of the first frame strictly after ``at`` (NULL if none)."""
    both = probes.withColumn("_at", F.col(at)).unionByName(
        frames.select(*KEYS, F.col("ts").alias("_at"), F.col("ts").alias("_frame")).distinct(),
        allowMissingColumns=True,
    )
    b = blocks.with_block(both, block_s, "_at")
    after = blocks.carry(b, KEYS, {"_beyond": F.min("_frame")}, F.min, backward=True)
    # latest first; at equal times the probe comes before the frame
    w = blocks.so_far(blocks.within(KEYS, F.col("_at").desc(), F.col("_frame").isNotNull().cast("int")))
    seen = blocks.join_carry(b.withColumn("_here", F.min("_frame").over(w)), after, KEYS)
    return (
        seen.where(F.col("_frame").isNull())
        .withColumn(out, F.coalesce("_here", "_beyond"))
        .drop("_frame", "_at", "_here", "_beyond", BLOCK)
    )


def covered(frames: DataFrame, spans: DataFrame, start: str, end: str, out: str, block_s: float) -> DataFrame:
    """Adds ``out``: some span of the same camera has start <= ts <= end."""
    s = spans.select(*KEYS, F.col(start).alias("_at"), F.col(end).alias("_end"))
    both = frames.withColumn("_at", F.col("ts")).withColumn("_is_frame", F.lit(1)).unionByName(
        s.withColumn("_is_frame", F.lit(0)), allowMissingColumns=True
    )
    b = blocks.with_block(both, block_s, "_at")
    before = blocks.carry(b, KEYS, {"_end0": F.max("_end")}, F.max)
    w = blocks.so_far(blocks.within(KEYS, "_at", "_is_frame"))
    reach = F.greatest(F.col("_here"), F.col("_end0"))
    return (
        blocks.join_carry(b.withColumn("_here", F.max("_end").over(w)), before, KEYS)
        .where(F.col("_is_frame") == 1)
        .withColumn(out, F.coalesce(reach >= F.col("ts"), F.lit(False)))
        .drop("_at", "_is_frame", "_end", "_end0", "_here", BLOCK)
    )


def nearest_frame(
    targets: DataFrame, frames: DataFrame, at: str, block_s: float, max_gap_s: float | None = None
) -> DataFrame:
    """Adds ``frame_ts``/``frame_idx`` of the frame closest in time to ``at``.

    On equal distance the earlier frame wins, then the lower index.
    """
    f = frames.select(*KEYS, F.col("ts").alias("_at"), F.struct("ts", "frame_idx").alias("_f"))
    both = targets.withColumn("_at", F.col(at)).unionByName(f, allowMissingColumns=True)
    b = blocks.with_block(both, block_s, "_at")
    # negated index: among equal times the maximum is the lowest index
    low = F.when(F.col("_f").isNotNull(), F.struct(F.col("_f.ts").alias("ts"), (-F.col("_f.frame_idx")).alias("neg")))
    b = b.withColumn("_p", low)
    before = blocks.carry(b, KEYS, {"_p0": F.max("_p")}, F.max)
    after = blocks.carry(b, KEYS, {"_n0": F.min("_f")}, F.min, backward=True)
    is_frame = F.col("_f").isNotNull().cast("int")
    up = blocks.so_far(blocks.within(KEYS, "_at", is_frame.desc()))
    down = blocks.so_far(blocks.within(KEYS, F.col("_at").desc(), is_frame))
    seen = b.withColumn("_p1", F.max("_p").over(up)).withColumn("_n1", F.min("_f").over(down))
    seen = blocks.join_carry(blocks.join_carry(seen.where(F.col("_f").isNull()), before, KEYS), after, KEYS)
    prev, nxt = F.coalesce("_p1", "_p0"), F.coalesce("_n1", "_n0")
    seen = seen.withColumn("_prev", prev).withColumn("_next", nxt)
    t = F.unix_micros("_at")
    back, fwd = t - F.unix_micros("_prev.ts"), F.unix_micros("_next.ts") - t
    use_prev = F.col("_next").isNull() | (F.col("_prev").isNotNull() & (back <= fwd))
    out = (
        seen.withColumn("gap_us", F.when(use_prev, back).otherwise(fwd))
        .withColumn("frame_ts", F.when(use_prev, F.col("_prev.ts")).otherwise(F.col("_next.ts")))
        .withColumn("frame_idx", F.when(use_prev, -F.col("_prev.neg")).otherwise(F.col("_next.frame_idx")))
    )
    if max_gap_s is not None:
        ok = F.col("gap_us") <= blocks.micros(max_gap_s)
        for c in ("frame_ts", "frame_idx"):
            out = out.withColumn(c, F.when(ok, F.col(c)))
    return out.drop("_at", "_f", "_p", "_p1", "_n1", "_p0", "_n0", "_prev", "_next", "gap_us", BLOCK)
