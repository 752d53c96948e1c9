"""Journal tables on parquet: pruned reads and insert-or-ignore appends."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide import schema
from eventide.session import stage

DATE = "created_date"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_table(spark: SparkSession, path: str, columns: T.StructType, partition: str | None = None) -> DataFrame:
    """A journal table, or an empty one before the first append."""
    full = T.StructType(columns.fields + ([T.StructField(partition, T.DateType())] if partition else []))
    if not _exists(spark, path):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(path)


def events(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, f"{root}/events", schema.EVENTS, DATE)


def clips(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, f"{root}/clips", schema.CLIPS)


def captions(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, f"{root}/captions", schema.CAPTIONS, DATE)


def quarantine(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, f"{root}/quarantine", schema.QUARANTINE)


DIGESTS = T.StructType([
    T.StructField("hour", T.TimestampType()), T.StructField("n", T.LongType()), T.StructField("digest", T.DecimalType(30, 0))])


def digests(spark: SparkSession, root: str) -> DataFrame:
    """Per hour of the journal: how many ids it has, and their digest."""
    return read_table(spark, f"{root}/digests", DIGESTS, "date")


def write_digests(rows: DataFrame, root: str) -> None:
    """Digests of whole dates of the journal, replaced date by date."""
    from eventide.plans.digests import hour_digests

    hour_digests(rows.select("created_utc", "event_id")).select("hour", "n", "digest", "date").coalesce(1).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("date").parquet(f"{root}/digests")


def scan_window(journal: DataFrame, start: Column, end: Column) -> DataFrame:
    """The rollup's columns of events created in [start, end]; prunes date partitions when there are any."""
    cols = [c for c in schema.ROLLUP_COLUMNS if c in journal.columns]
    df = journal
    if DATE in df.columns:
        df = df.where(F.col(DATE).between(F.to_date(start), F.to_date(end)))
    return df.where(F.col("created_utc").between(start, end)).select(*cols)


def newest_part(spark: SparkSession, root: str) -> DataFrame:
    """Events of the newest date folder: found by listing folders, without reading older data."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/events")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    dates = sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{DATE}=") and "__" not in n)
    found = events(spark, root)
    return found.where(F.col(DATE) == F.lit(dates[-1]).cast("date")) if dates else found.limit(0)


def on_dates_of(existing: DataFrame, batch: DataFrame, partition: str = DATE) -> DataFrame:
    """``existing`` reduced to the dates of ``batch``, as a filter that prunes folders.

    The batch's range of dates is a filter on both sides, which prunes folders
    when the plan is made; the join with the batch's own dates, a small table,
    prunes the others when it runs.
    """
    dates = stage(batch.select(partition).distinct())
    lo, hi = dates.agg(F.min(partition), F.max(partition)).first()
    if lo is None:
        return existing.where(F.lit(False))
    inside = F.col(partition).between(lo, hi)
    return existing.where(inside).join(dates.where(inside), partition, "left_semi").select(*existing.columns)


def new_rows(batch: DataFrame, existing: DataFrame, key: str, partition: str | None = None) -> DataFrame:
    """Rows of ``batch`` whose key is new, one per key.

    Equal keys mean equal content, hence equal dates: with a date partition
    only the batch's own dates of the existing table are read.  The copies of a
    repeated key are merged map-side before the shuffle.
    """
    known = existing if partition is None else on_dates_of(existing, batch, partition)
    return batch.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def append_new(
    batch: DataFrame, existing: DataFrame, path: str, key: str, partition: str | None = None
) -> int:
    """Insert-or-ignore; returns how many rows were added.  Re-running adds none."""
    seen = Observation()
    fresh = new_rows(batch, existing, key, partition).observe(seen, F.count(F.lit(1)).alias("n"))
    if partition:
        # files by measured size: a hot day gets several tasks, a small batch few files
        fresh = fresh.hint("rebalance", F.col(partition))
        fresh.write.mode("append").partitionBy(partition).parquet(path)
    else:
        fresh.write.mode("append").parquet(path)
    return observed(seen)


def observed(seen: Observation) -> int:
    """Rows counted while writing.

    When Spark finds at run time that nothing is to be written, it drops the
    counter from the plan and the observation stays without a row.
    """
    try:
        return int(seen.get["n"])
    except Py4JJavaError:
        return 0
