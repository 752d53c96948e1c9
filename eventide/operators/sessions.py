"""Sessions by inactivity gap, for keys of any size (H11 in batch)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.operators import blocks
from eventide.operators.blocks import BLOCK
from eventide.session import stage


def sessions(df: DataFrame, keys: Sequence[str], order: Sequence[str], gap_s: float, block_s: float) -> DataFrame:
    """One row per session: start, last row and number of rows.

    A new session begins more than ``gap_s`` after the row before, as with
    ``session_window``; but no key is gathered in one task.  ``order`` starts
    with the timestamp.
    """
    ts = order[0]
    keys = list(keys)
    b = blocks.with_block(df, block_s, ts)
    before = blocks.carry(b, keys, {"_before": F.max(ts)}, F.max)
    w = blocks.within(keys, *order)
    prev = F.coalesce(F.lag(ts).over(w), F.col("_before"))
    starts = prev.isNull() | (F.unix_micros(ts) - F.unix_micros(prev) > blocks.micros(gap_s))
    flagged = blocks.join_carry(b, before, keys).withColumn("_starts", starts.cast("int"))
    pieces = flagged.withColumn("_seq", F.sum("_starts").over(blocks.so_far(w))).groupBy(*keys, BLOCK, "_seq").agg(
        F.min(ts).alias("_head"), F.max(ts).alias("_last"), F.count(F.lit(1)).alias("_n")
    )
    return (
        blocks.stitch(stage(pieces), keys)
        .groupBy(*keys, F.col("_island").alias("session_start"))
        .agg(F.max("_last").alias("session_last"), F.sum("_n").alias("events"))
    )
