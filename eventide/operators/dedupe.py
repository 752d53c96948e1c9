"""Duplicates within a time window of the same clip, kind and payload (C4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.functions.payload import sha1_short

SAME = ["clip_id", "kind", "_sig"]


def windowed_duplicates(batch: DataFrame, existing: DataFrame, seconds: float, how: str = "left_semi") -> DataFrame:
    """Rows of ``batch`` with (``left_anti``: without) a known row at most ``seconds`` away in ``t0_ms``.

    Only rows with a clip take part.  Known rows are reduced to distinct
    (clip, kind, payload, t0) first and each offers itself to the three time
    buckets its window can touch, so the join is an equi-join on a fine key.
    """
    w = int(seconds * 1000)
    width = max(1, 2 * w)
    sig = sha1_short(F.col("payload"), 16)
    bucket = lambda t: F.floor(t / F.lit(width)).cast("bigint")
    t0 = F.col("t0_ms")
    known = (
        existing.where(F.coalesce("clip_id", F.lit("")) != "")
        .select("clip_id", "kind", sig.alias("_sig"), t0.alias("_t"))
        .distinct()
        .withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_t") - w), bucket(F.col("_t") + w))))
    )
    left = batch.withColumn("_sig", sig).withColumn("_bucket", bucket(t0))
    low = F.greatest(F.lit(0), F.col("b.t0_ms") - w)
    cond = F.col("k._t").between(low, F.col("b.t0_ms") + w)
    for c in [*SAME, "_bucket"]:
        cond = (F.col(f"b.{c}") == F.col(f"k.{c}")) & cond
    return left.alias("b").join(known.alias("k"), cond, how).drop("_sig", "_bucket")


def drop_windowed_duplicates(batch: DataFrame, existing: DataFrame, seconds: float) -> DataFrame:
    return windowed_duplicates(batch, existing, seconds, "left_anti")
