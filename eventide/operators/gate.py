"""Motion gate: over-threshold runs and the live flag."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions.signals import over_gate
from eventide.operators import blocks
from eventide.operators.blocks import BLOCK
from eventide.params import PerceptionParams

KEYS = ["camera"]
ORDER = ["ts", "frame_idx"]


def gate_runs(frames: DataFrame, p: PerceptionParams) -> DataFrame:
    """Adds ``over`` and ``run``: how many frames in a row, up to this one, are over the gate."""
    over = over_gate(F.col("motion"), p.motion_threshold, p.min_motion_area_frac)
    b = blocks.with_block(frames.withColumn("over", F.coalesce(over, F.lit(False))), p.block_s)
    w = blocks.within(KEYS, *ORDER)
    local = b.withColumn("_rn", F.row_number().over(w)).withColumn(
        "_off", F.max(F.when(~F.col("over"), F.col("_rn"))).over(blocks.so_far(w))
    )
    # per block: frames at its end that are over, and whether all of it is
    ends = local.groupBy(*KEYS, BLOCK).agg(
        (F.count(F.lit(1)) - F.coalesce(F.max(F.when(~F.col("over"), F.col("_rn"))), F.lit(0))).alias("_tail"),
        F.bool_and("over").alias("_all"),
    )
    per_key = Window.partitionBy(*KEYS).orderBy(BLOCK)
    islands = ends.withColumn(
        "_island", F.sum(F.when(F.col("_all"), 0).otherwise(1)).over(per_key)
    )
    reach = F.sum("_tail").over(Window.partitionBy(*KEYS, "_island").orderBy(BLOCK))
    entering = islands.withColumn("_reach", reach).select(
        *KEYS, BLOCK, F.coalesce(F.lag("_reach").over(per_key), F.lit(0)).alias("_enter")
    )
    run = (
        F.when(~F.col("over"), 0)
        .when(F.col("_off").isNull(), F.col("_rn") + F.col("_enter"))
        .otherwise(F.col("_rn") - F.col("_off"))
    )
    return blocks.join_carry(local, entering, KEYS).withColumn("run", run.cast("bigint")).drop(
        "_rn", "_off", "_enter", BLOCK
    )


def live_frames(frames: DataFrame, p: PerceptionParams) -> DataFrame:
    """Adds ``live``: gate held long enough, or something present.  Needs ``presence``."""
    if p.min_motion_frames <= 1:
        over = over_gate(F.col("motion"), p.motion_threshold, p.min_motion_area_frac)
        return frames.withColumn("live", F.coalesce(over, F.lit(False)) | F.col("presence"))
    return gate_runs(frames, p).withColumn(
        "live", (F.col("run") >= p.min_motion_frames) | F.col("presence")
    ).drop("over", "run")
