"""Verification by digests (D21, J3, J4): order-free sums of hashed ids by hour, compared from the days down.

Equal sets have equal digests.  Only hours whose digests differ are looked at by id; a clean journal is verified without one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.functions.times import hour_start
from eventide.plans import verify
from eventide.session import stage
from eventide.sources.journal import DATE


def hour_digests(ids: DataFrame) -> DataFrame:
    """(date, hour, n, digest) of rows with created_utc and event_id, each id once."""
    known = ids.where((F.coalesce("event_id", F.lit("")) != "") & F.col("created_utc").isNotNull())
    hour = hour_start(F.col("created_utc"))
    return known.groupBy(F.to_date("created_utc").alias("date"), hour.alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("event_id").cast("decimal(20,0)")).alias("digest"))


def differing_hours(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(date, hour) of ``asked`` whose digests aren't those of ``known``: days first, then the hours of the days that differ."""
    def sums(d: DataFrame, name: str) -> DataFrame:
        return d.groupBy("date").agg(F.sum("n").alias(f"n_{name}"), F.sum("digest").alias(f"d_{name}"))

    same = lambda: F.col("n_a").eqNullSafe(F.col("n_b")) & F.col("d_a").eqNullSafe(F.col("d_b"))
    days = sums(asked, "a").join(sums(known, "b"), "date", "left").where(~same()).select("date")
    named = lambda d, x: d.join(days, "date", "left_semi").select("date", "hour", F.col("n").alias(f"n_{x}"), F.col("digest").alias(f"d_{x}"))
    return named(asked, "a").join(named(known, "b"), ["date", "hour"], "left").where(~same()).select("date", "hour")


def verification(ids: DataFrame, journal: DataFrame, asked: DataFrame, known: DataFrame, n: int = verify.SAMPLE) -> DataFrame:
    """What :func:`verify.verification` gives, with ids read for the differing hours alone; runs a job.

    ``ids`` has created_utc and event_id of what was summarised, ``journal`` its events; ``asked`` and ``known`` are their stored
    digests.  Both tables are pruned by the dates that differ where they are partitioned by them.
    """
    hours = stage(differing_hours(asked, known))
    lo, hi = hours.agg(F.min("date"), F.max("date")).first()

    def part(df: DataFrame, date: str) -> DataFrame:
        if lo is None:
            return df.where(F.lit(False))
        near = df.where(F.col(date).between(lo, hi)) if date in df.columns else df
        hour = hour_start(F.col("created_utc"))
        return near.withColumn("_hour", hour).join(hours.select(F.col("hour").alias("_hour")), "_hour", "left_semi").select("event_id")

    total = asked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("checked_event_ids"))
    found = verify.verification(part(ids, "date"), part(journal, DATE), n)
    return total.select("checked_event_ids", found.select("missing_event_ids").scalar().alias("missing_event_ids"),
                        found.select("missing_ids_sample").scalar().alias("missing_ids_sample"))
