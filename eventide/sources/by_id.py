"""Journal events laid out by id: buckets of ids inside each date, so that insert-or-ignore moves only the batch.

The files are plain parquet in date folders, which every other reader takes by path.  What is added is where a row goes:
the hash of its id names its bucket, in every date.  A join of a batch with such a table shuffles the batch into as many
partitions and reads the journal bucket by bucket where it lies; the rows that are left are written without another shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.session import stage
from eventide.sources import journal, jsonl

LAYOUT = T.StructType([T.StructField("buckets", T.IntegerType())])
NAMED_DATES = 1000  # dates of a batch that are named in the filter; more are read as a range


def buckets_of(spark: SparkSession, root: str) -> int | None:
    """The number of buckets of the journal's events; None for a journal that is not laid out by id."""
    row = journal.read_table(spark, f"{root}/events_layout", LAYOUT).first()
    return row.buckets if row else None


def lay_out(spark: SparkSession, root: str, buckets: int) -> None:
    """Declare a new journal's events as bucketed; nothing happens if they are so already.

    A bucket of one date should fill a file of some hundred MB.  The number stays for good: a different one, or events
    that were written without buckets, are refused.
    """
    if buckets < 1:
        raise ValueError("buckets must be positive")
    known = buckets_of(spark, root)
    if known == buckets:
        return
    if known is not None or not journal.events(spark, root).isEmpty():
        raise ValueError(f"the events under {root} have {known or 'no'} buckets")
    spark.createDataFrame([(buckets,)], LAYOUT).coalesce(1).write.parquet(f"{root}/events_layout")


def table(spark: SparkSession, path: str, columns: T.StructType, key: str, partition: str, buckets: int) -> str:
    """The name under which the session's catalogue knows the files at ``path`` with their buckets."""
    name = "laid_out_" + hashlib.sha1(f"{path} {buckets}".encode()).hexdigest()[:16]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*columns.fields, T.StructField(partition, T.DateType())])
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({types}) USING parquet PARTITIONED BY ({partition}) "
              f"CLUSTERED BY ({key}) INTO {buckets} BUCKETS LOCATION '{place}'")
    if jsonl.pick_existing(spark, [path]):
        spark.sql(f"MSCK REPAIR TABLE {name}")  # dates that other sessions have added
        spark.catalog.refreshTable(name)
    return name


def new_rows(batch: DataFrame, existing: DataFrame, key: str, partition: str, buckets: int) -> DataFrame:
    """Rows of ``batch`` whose key is not in the bucketed ``existing``, one per key; only the batch is shuffled."""
    dates = stage(batch.select(partition).distinct())
    lo, hi, n = dates.agg(F.min(partition), F.max(partition), F.count(partition)).first()
    if lo is None:
        known = existing.where(F.lit(False))
    elif n <= NAMED_DATES:
        known = existing.where(F.col(partition).isin([r[0] for r in dates.dropna().collect()]))
    else:
        known = existing.where(F.col(partition).between(lo, hi))
    return batch.repartition(buckets, key).dropDuplicates([key]).join(known.select(key), key, "left_anti")


def append_new(
    batch: DataFrame, path: str, columns: T.StructType, key: str, partition: str, buckets: int
) -> int:
    """Insert-or-ignore into bucketed files; returns how many rows were added.  Re-running adds none."""
    name = table(batch.sparkSession, path, columns, key, partition, buckets)
    seen = Observation()
    fresh = new_rows(batch, batch.sparkSession.table(name), key, partition, buckets)
    fresh = fresh.observe(seen, F.count(F.lit(1)).alias("n")).select(*columns.names, partition)
    fresh.write.insertInto(name)
    return journal.observed(seen)
