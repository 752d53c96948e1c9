"""Audit jobs: journal health, clip mapping, and peek."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.functions import payload as P
from eventide.functions.times import strip
from eventide.params import IngestParams
from eventide.plans import ingest

PEEK_KEYS = 8  # fixed value: keys shown per line


def journal_audit(events: DataFrame, clips: DataFrame, captions: DataFrame) -> DataFrame:
    """Rows, distinct keys and missing times per table; keys repeat when the first two differ."""

    def check(name: str, df: DataFrame, key: str, ts: str | None) -> DataFrame:
        # count per key first: the distinct count then needs no second copy of the rows
        keyed = df.groupBy(key).agg(
            F.count(F.lit(1)).alias("n"),
            (F.count_if(F.col(ts).isNull()) if ts else F.lit(0).cast("bigint")).alias("nulls"),
        )
        return keyed.agg(
            F.lit(name).alias("table_name"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
            F.count(key).alias("distinct_keys"),
            F.coalesce(F.sum("nulls"), F.lit(0)).alias("null_times"),
        )

    return (
        check("captions", captions, "event_id", "created_utc")
        .unionByName(check("clips", clips, "clip_id", None))
        .unionByName(check("events", events, "event_id", "created_utc"))
    )


def clip_audit(parsed: DataFrame, segments: DataFrame, p: IngestParams, sample: int | None = None) -> DataFrame:
    """Does the clip a line names exist: OK or MISS.  ``sample`` keeps the first numbered lines."""
    lines = parsed.where(F.col("obj").isNotNull())
    if sample:
        lines = lines.orderBy("file", "line_no").limit(sample)
    clip = P.media_path(strip(P.text_of(F.col("obj.clip"))), F.regexp_replace("file", "^file:/+", "/"), p.clips_dir)
    elsewhere = ingest.named_files(parsed.sparkSession, lines, p)
    known = segments.select("path").unionByName(elsewhere).select(F.col("path").alias("clip_path"), F.lit(1).alias("_known")).distinct()
    return (
        lines.withColumn("clip_path", clip)
        .drop("line", "obj")
        .join(known, "clip_path", "left")
        .withColumn("tag", F.when(F.col("_known").isNotNull(), "OK").otherwise("MISS"))
        .drop("_known")
    )


def peek(parsed: DataFrame, p: IngestParams, n: int | None = None) -> DataFrame:
    """Kind, leading keys and clip of numbered lines, the first ``n`` in file and line order."""
    lines = parsed.where(F.col("obj").isNotNull())
    if n:
        lines = lines.orderBy("file", "line_no").limit(n)
    v = F.col("obj")
    keys = F.json_object_keys("line")
    clip = P.media_path(strip(P.text_of(v["clip"])), F.regexp_replace("file", "^file:/+", "/"), p.clips_dir)
    return lines.select(
        "file", "line_no", P.kind_of(v).alias("kind"),
        F.slice(keys, 1, PEEK_KEYS).alias("keys"),
        (F.size(keys) > PEEK_KEYS).alias("more_keys"),
        clip.alias("clip_path"),
        F.lit(p.pre_ms).alias("pre_ms"), F.lit(p.post_ms).alias("post_ms"),
    )
