"""A rollup that follows the journal (A10, A11, H12): only the hours that a batch touched are aggregated again.

Every merge marks the hours of its rows beside the journal, late rows like all others, before and after it adds them.  A refresh
takes the marks it has not seen, reads these hours' events, and replaces their partitions; days are built from the
stored grain.  A refresh that is interrupted is repeated whole, since its marks are noted last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.functions.times import hour_start
from eventide.plans import digests, documents, rollup, sketches
from eventide.session import require_utc, scratch, stage
from eventide.sources import journal as J

PARTS = ["date", "hh"]
_MARKS = T.StructType([T.StructField("mark", T.StringType()), T.StructField("hour", T.TimestampType())])


def mark(batch: DataFrame, root: str) -> None:
    """Note the hours of a batch of event rows."""
    hours = batch.where(F.col("created_utc").isNotNull()).select(hour_start(F.col("created_utc")).alias("hour")).distinct()
    hours.select(F.lit(uuid.uuid4().hex).alias("mark"), "hour").coalesce(1).write.mode("append").parquet(f"{root}/touched")


def pending(spark: SparkSession, journal_root: str, out_root: str) -> DataFrame:
    """Marks (mark, hour) that no refresh into ``out_root`` has taken."""
    done = J.read_table(spark, f"{out_root}/refreshed", T.StructType(_MARKS.fields[:1]))
    return J.read_table(spark, f"{journal_root}/touched", _MARKS).join(done, "mark", "left_anti")


def touched_events(spark: SparkSession, journal_root: str, hours: DataFrame) -> DataFrame:
    """Events of these hours; other dates' folders are not read."""
    dated = hours.select(F.to_date("hour").alias(J.DATE), "hour")
    near = J.on_dates_of(J.events(spark, journal_root), dated)
    cols = near.columns
    return near.withColumn("hour", hour_start(F.col("created_utc"))).join(hours, "hour", "left_semi").select(*cols)


def _replace(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Replace the hours that ``df`` holds."""
    dated = df.withColumns({"date": F.to_date("hour"), "hh": F.date_format("hour", "HH")})
    writer = dated.hint("rebalance", *map(F.col, PARTS)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.option("ignoreNullFields", "false").partitionBy(*PARTS).format(kind).save(path)


def refresh(spark: SparkSession, journal_root: str, out_root: str) -> int:
    """Bring the rollup under ``out_root`` up to date; returns how many hours were aggregated.

    Tables by date and hour: ``grain``, ``tokens``, ``hour_ids``, ``hour_digests``, ``hour_sketches``, ``hourly`` (documents); by date: ``days``.
    """
    require_utc(spark)
    with scratch(spark):
        marks = stage(pending(spark, journal_root, out_root))
        hours = stage(marks.select("hour").distinct())
        n = hours.count()
        if n:
            _refresh(spark, journal_root, out_root, hours)
            marks.select("mark").distinct().coalesce(1).write.mode("append").parquet(f"{out_root}/refreshed")
    return n


def _refresh(spark: SparkSession, journal_root: str, out_root: str, hours: DataFrame) -> None:
    events = touched_events(spark, journal_root, hours)
    g, tokens = stage(rollup.grain(events)), stage(rollup.token_grain(events))
    _replace(rollup.hour_event_ids(events), f"{out_root}/{documents.IDS_TABLE}")
    _replace(digests.hour_digests(events).drop("date"), f"{out_root}/hour_digests")
    _replace(sketches.hour_sketches(g), f"{out_root}/hour_sketches")
    _replace(g, f"{out_root}/grain")
    _replace(tokens, f"{out_root}/tokens")
    rows = rollup.hourly(g).withColumn("hour_end", rollup.hour_end(F.col("hour")))
    _replace(documents.hourly_documents(rows, g, tokens), f"{out_root}/hourly", "json")
    dates = stage(hours.select(F.to_date("hour").alias("date")).distinct())
    day_rows(table(spark, out_root, "grain", g.schema), table(spark, out_root, "hour_sketches", sketches.hour_sketches(g).schema), dates).write.mode(
        "overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(f"{out_root}/days")


def table(spark: SparkSession, out_root: str, name: str, schema: T.StructType) -> DataFrame:
    """A table of the rollup, with its partition columns."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("date", T.DateType()), T.StructField("hh", T.StringType())])).parquet(
        f"{out_root}/{name}")


def day_rows(g: DataFrame, sk: DataFrame, dates: DataFrame) -> DataFrame:
    """Totals of these dates from the stored grain, empty hours included, and distinct counts from the sketches."""
    mine = g.join(dates, "date", "left_semi").drop(*PARTS)
    of_day = rollup.daily(rollup.hourly_filled(mine)).join(dates, "date", "left_semi")
    return of_day.join(sketches.distincts(sk.join(dates, "date", "left_semi"), F.col("date")), "date")
