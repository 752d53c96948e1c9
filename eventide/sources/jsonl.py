"""JSON-lines shards: scan with exact line numbers, quarantine, shard sinks."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventide.functions.payload import RECORD
from eventide.functions.times import WS_CHARS, strip

QUARANTINE_CHARS = 200  # fixed value: how much of a bad line is kept


def scan_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, line`` plus the position columns ``split, row_id`` that :func:`number_lines` needs.

    Files stay splittable, and nothing is shuffled.
    """
    return spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row_id"),
        F.col("value").alias("line"),
    )


def number_lines(rows: DataFrame, scan: DataFrame) -> DataFrame:
    """Adds ``line_no``, from 1 per file, to any subset of the rows of ``scan``.

    A line's number is its position in its split plus the lines of the file's
    earlier splits; those come from a table with one row per split.  Filter
    first, number later: only the rows left are joined.
    """
    splits = scan.groupBy("file", "split").agg(F.min("row_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(
        "file", "split", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_base")
    )
    return (
        rows.join(splits, ["file", "split"])
        .withColumn("line_no", (F.col("row_id") + F.col("_base") + 1).cast("bigint"))
        .drop("_base", "split", "row_id")
    )


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, line, line_no`` of every line."""
    scan = scan_lines(spark, paths)
    return number_lines(scan, scan)


def shard_paths(root: str, glob: str = "*/*.jsonl") -> str:
    return f"{root.rstrip('/')}/{glob}"


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``value`` passes a generator: what stands above reads it instead of computing it again."""
    return df.withColumn(name, F.explode(F.array(value)))


def _trimmed(line: Column) -> Column:
    """:func:`strip`, which walks through the whole line, only where an end has white space."""
    edge = F.left(line, F.lit(1)).isin(*WS_CHARS) | reduce(or_, map(line.endswith, WS_CHARS))
    return F.when(edge, strip(line)).otherwise(line)


def clean_lines(lines: DataFrame, once: bool = False) -> DataFrame:
    """Trimmed lines without blanks and ``#`` comments; numbering is untouched.

    ``once``, for long lines and such as are costly to make: each is made once and walked through only if it needs
    trimming, but filters on lines no longer reach the scan.
    """
    line = F.col("line")
    read = _once(_once(lines, "line", line), "line", _trimmed(line)) if once else lines.withColumn("line", strip(line))
    return read.where((line != "") & ~line.startswith("#"))


def first_lines(lines: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` numbered lines in file, then line order, bad ones included."""
    return clean_lines(lines).orderBy("file", "line_no").limit(limit)


def parse_lines(lines: DataFrame, once: bool = False) -> DataFrame:
    """Adds ``obj``, the record of a line; NULL for one that is not exactly one JSON object.

    Lines are parsed inside brackets, so trailing text or a second object on
    the line makes them invalid.  The record passes a generator: filters on its
    fields then stay above it instead of parsing the line once more.
    """
    line = F.col("line")
    arr = F.try_parse_json(F.concat(F.lit("["), line, F.lit("]")))
    whole = line.startswith("{") & line.endswith("}")
    return (
        clean_lines(lines, once)
        .withColumn("_arr", F.when(whole, arr))
        .withColumn("obj", F.when(
            F.try_variant_get("_arr", "$[1]", "variant").isNull(), F.try_variant_get("_arr", "$[0]", RECORD)))
        .drop("_arr")
        .withColumn("obj", F.explode_outer(F.array("obj")))
    )


def quarantine(parsed: DataFrame) -> DataFrame:
    """Lines that cannot be journalled: not a JSON object.  Number them with :func:`number_lines`."""
    return parsed.where(F.col("obj").isNull()).drop("obj").withColumn(
        "line", F.left("line", F.lit(QUARANTINE_CHARS))
    )


def write_shards(events: DataFrame, root: str, roll: str = "hour", tz: str = "UTC", mode: str = "append") -> list[str]:
    """Event lines to ``<date>/<hour>_<part>.jsonl`` (or ``<date>/<part>.jsonl``) by local time; returns the new files.

    ``events`` needs ``ts`` and ``line``.  Parts are sized by what they hold, so
    one hot hour is written by several tasks.  They are written to a folder of
    their own under ``root`` that no shard pattern meets, and take their names
    when all are complete: a failed run leaves no half of a shard behind.  With
    mode ``overwrite`` the shards found before then go.
    """
    spark = events.sparkSession
    wall = F.from_utc_timestamp("ts", tz)
    df = events.withColumn("date", F.date_format(wall, "yyyy-MM-dd"))
    folders = ["date"]
    if roll == "hour":
        df = df.withColumn("hour", F.date_format(wall, "HH"))
        folders.append("hour")
    parts = f"{root.rstrip('/')}/_parts/{uuid.uuid4().hex}"
    (
        df.hint("rebalance", *(F.col(f) for f in folders))
        .sortWithinPartitions(*folders, "ts", *(["seq"] if "seq" in df.columns else []))
        .select(*folders, F.col("line").alias("value"))
        .write.partitionBy(*folders)
        .text(parts)
    )
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    old = [s.getPath() for s in (fs.globStatus(path(f"{root.rstrip('/')}/*/*.jsonl")) or [])] if mode == "overwrite" else []
    made, each = [], fs.listFiles(path(parts), True)
    while each.hasNext():
        at = each.next().getPath()
        found = dict(f.split("=", 1) for f in str(at.getParent()).split("/") if "=" in f)
        name = at.getName()
        if name.startswith("part-"):
            stem = "_".join(filter(None, (found.get("hour"), name.split(".", 1)[0])))
            to = path(f"{root.rstrip('/')}/{found['date']}/{stem}.jsonl")
            fs.mkdirs(to.getParent())
            if not fs.rename(at, to):
                raise OSError(f"cannot name {to}")
            made.append(str(to))
    for at in [*old, path(parts)]:
        fs.delete(at, True)
    return sorted(made)


def pick_existing(spark: SparkSession, candidates: list[str]) -> str | None:
    """First path that exists, by the cluster's file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for c in candidates:
        path = jvm.org.apache.hadoop.fs.Path(c)
        if path.getFileSystem(conf).exists(path):
            return c
    return None
