"""Rollup verification: do summarised ids exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.sources.journal import DATE

SAMPLE = 20  # fixed value: how many missing ids a report shows


def distinct_ids(ids: DataFrame) -> DataFrame:
    return ids.where(F.coalesce(F.col("event_id"), F.lit("")) != "").select("event_id").distinct()


def missing_ids(ids: DataFrame, journal: DataFrame) -> DataFrame:
    return distinct_ids(ids).join(journal.select("event_id"), "event_id", "left_anti")


def present_ids(ids: DataFrame, journal: DataFrame) -> DataFrame:
    return distinct_ids(ids).join(journal.select("event_id"), "event_id", "left_semi")


def verification(ids: DataFrame, journal: DataFrame, n: int = SAMPLE) -> DataFrame:
    """One row: ids checked, ids missing and the first ``n`` of those, from one join.

    Where both sides have a ``created_date`` it is part of the key: filter the
    journal to the dates asked for, and no other folder is read.
    """
    key = [c for c in (DATE, "event_id") if c in ids.columns and c in journal.columns]
    asked = ids.where(F.coalesce(F.col("event_id"), F.lit("")) != "").select(*key).distinct()
    known = journal.select(*key).distinct().withColumn("_known", F.lit(1))
    tagged = asked.join(known, key, "left").withColumn("_missing", F.when(F.col("_known").isNull(), F.col("event_id")))
    place = F.row_number().over(Window.partitionBy(F.col("_missing").isNull()).orderBy("_missing"))
    first = tagged.where(F.col("_missing").isNotNull()).withColumn("_k", place).where(F.col("_k") <= n)
    sample = first.agg(F.array_sort(F.collect_list("_missing")).alias("missing_ids_sample"))
    totals = tagged.agg(F.count(F.lit(1)).alias("checked_event_ids"), F.count("_missing").alias("missing_event_ids"))
    return totals.select("*", sample.scalar().alias("missing_ids_sample"))


def missing_sample(ids: DataFrame, journal: DataFrame, n: int = SAMPLE) -> DataFrame:
    return missing_ids(ids, journal).orderBy("event_id").limit(n)


def count_in_window(journal: DataFrame, start, end) -> DataFrame:
    """Fallback when there are no ids to check."""
    if DATE in journal.columns:
        journal = journal.where(F.col(DATE).between(F.to_date(start), F.to_date(end)))
    return journal.where(F.col("created_utc").between(start, end)).agg(F.count(F.lit(1)).alias("db_count_in_window"))
