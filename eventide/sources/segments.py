"""Media segments as a table: listing, bounds and clip ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.functions.payload import clip_id, segment_bounds
from eventide.functions.times import iso_z


def list_segments(spark: SparkSession, clips_dir: str) -> DataFrame:
    """Paths of every file under the recordings folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(clips_dir)
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"))


def list_files(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Paths of the files directly in some folders; contents are not read."""
    files = spark.read.format("binaryFile").load([f"{f.rstrip('/')}/*" for f in folders])
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"))


def with_bounds(segments: DataFrame) -> DataFrame:
    """``path`` to ``clip_id, path, start_utc, end_utc``."""
    start, end = segment_bounds(F.col("path"))
    s = segments.select("path", start.alias("start_utc"), end.alias("end_utc"))
    return s.select(
        clip_id(F.col("path"), iso_z(F.col("start_utc")), iso_z(F.col("end_utc"))).alias("clip_id"),
        "path", "start_utc", "end_utc",
    )
