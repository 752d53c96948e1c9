"""Hourly and daily rollups of the journal.

The journal is read once and reduced to one row per (hour, kind, source, clip):
the grain.  Every count, map, distinct and score of an hour or a day is a
second, small aggregation of the grain, so no wide row is expanded for a
distinct count and no map is merged.  Words take the same route on their own
grain of (hour, token).
"""

from __future__ import annotations

import datetime as dt
import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventide.functions import payload as P
from eventide.functions import signals as S
from eventide.functions import text as X
from eventide.functions.times import hour_end, hour_start, iso_z, parse_ts, strip
from eventide.schema import ROLLUP_COLUMNS

GRAIN = ["hour", "kind", "source", "clip_id"]
SCORE = "decimal(28,12)"  # scores add up exactly, in any order


def complete(journal: DataFrame) -> DataFrame:
    """The rollup's columns; a missing one becomes NULL, with a warning."""
    types = {"t0_ms": "bigint", "t1_ms": "bigint", "created_utc": "timestamp"}
    for c in ROLLUP_COLUMNS:
        if c not in journal.columns:
            warnings.warn(f"column {c} missing; partial metrics", stacklevel=2)
            journal = journal.withColumn(c, F.lit(None).cast(types.get(c, "string")))
    return journal.select(*ROLLUP_COLUMNS)


def measured(journal: DataFrame) -> DataFrame:
    """Per-event measures: duration, speech and motion.  The payload is parsed once."""
    body = F.from_json(
        "payload", "type string, start_utc string, end_utc string, text string, motion_score string"
    )
    c = F.col
    # most payloads hold nothing measured here: a text search is far cheaper than a parse
    relevant = P.is_speech(c("kind")) | (c("kind") == P.MOTION_KIND) | c("payload").contains(P.MOTION_KIND)
    df = complete(journal).where(c("created_utc").isNotNull()).withColumn("_b", F.when(relevant, body))
    t0, t1 = c("t0_ms"), c("t1_ms")
    spoken = P.speech_seconds(parse_ts(c("_b.start_utc")), parse_ts(c("_b.end_utc")), t0, t1)
    score = F.coalesce(c("_b.motion_score").try_cast("double"), F.lit(0.0))
    motion = P.is_motion(c("kind"), c("_b.type"))
    return df.select(
        "event_id", "source", "kind", "clip_id", "created_utc",
        hour_start(c("created_utc")).alias("hour"),
        F.when(t1 >= t0, t1 - t0).alias("duration_ms"),
        F.when(P.is_speech(c("kind")), F.round(spoken * 1_000_000).cast("bigint")).alias("speech_us"),
        F.when(c("kind") == "speech", strip(c("_b.text"))).alias("text"),
        F.when(motion, score).alias("motion"),
    )


def grain(journal: DataFrame) -> DataFrame:
    """One row per (hour, kind, source, clip) with every additive measure."""
    c = F.col
    return measured(journal).groupBy(*GRAIN).agg(
        F.count(F.lit(1)).alias("events"),
        F.sum("duration_ms").alias("duration_ms"),
        F.min("created_utc").alias("first_created"),
        F.max("created_utc").alias("last_created"),
        F.sum("speech_us").alias("speech_us"),
        F.sum(X.word_count(c("text"))).alias("speech_words"),
        F.sum(F.char_length("text")).alias("speech_chars"),
        F.count("motion").alias("motion_events"),
        F.sum(c("motion").try_cast(SCORE)).alias("motion_sum"),
        F.max("motion").alias("motion_max"),
    )


def _zero(c: Column, type_: str = "bigint") -> Column:
    return F.coalesce(c, F.lit(0)).cast(type_)


def hourly(g: DataFrame) -> DataFrame:
    """One row per hour with events."""
    c = F.col
    of_kind = lambda k: F.sum(F.when(c("kind") == k, c("events")))
    h = g.groupBy("hour").agg(
        F.sum("events").alias("total_events"),
        # no source at all counts as one more source
        (F.count_distinct("source") + F.max(c("source").isNull().cast("int"))).alias("unique_sources"),
        F.count_distinct(F.nullif("clip_id", F.lit(""))).alias("unique_clips"),
        _zero(F.sum("duration_ms")).alias("sum_duration_ms"),
        F.min("first_created").alias("first_created"),
        F.max("last_created").alias("last_created"),
        _zero(of_kind("speech")).alias("speech_events"),
        _zero(of_kind("speech.suppressed")).alias("speech_suppressed_events"),
        (_zero(F.sum("speech_us")) / F.lit(1e6)).alias("speech_seconds"),
        _zero(F.sum("speech_words")).alias("speech_words"),
        _zero(F.sum("speech_chars")).alias("speech_chars"),
        _zero(F.sum("motion_events")).alias("motion_summary_events"),
        _zero(F.sum("motion_sum"), "double").alias("motion_peak_score_sum"),
        F.greatest(F.lit(0.0), F.max("motion_max")).alias("motion_peak_score_max"),
    )
    return scored(h)


def scored(h: DataFrame) -> DataFrame:
    c = F.col
    h = h.withColumn(
        "avg_motion_score",
        F.coalesce(c("motion_peak_score_sum") / F.nullif(c("motion_summary_events"), F.lit(0)), F.lit(0.0)),
    )
    return h.withColumn(
        "excitement_score", F.round(S.excitement(c("avg_motion_score"), c("speech_seconds")), 3)
    ).withColumn("excitement_basis", S.excitement_basis(c("avg_motion_score"), c("speech_seconds")))


def one_row(spark: SparkSession, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Window bounds as a table."""
    return spark.range(1).select(F.lit(start).alias("start"), F.lit(end).alias("end"))


def hour_spine(bounds: DataFrame) -> DataFrame:
    """Every hour from ``start`` to ``end`` of a one-row table."""
    hours = F.sequence(hour_start(F.col("start")), hour_start(F.col("end")), F.expr("INTERVAL '1' HOUR"))
    return bounds.select(F.explode(hours).alias("hour"))


def day_bounds_of(hours: DataFrame) -> DataFrame:
    """One row: first day start to last day end of hourly rows."""
    ends = hours.agg(F.min("hour").alias("a"), F.max("hour").alias("z"))
    day = F.expr("INTERVAL '23:59:59' HOUR TO SECOND")
    return ends.select(F.date_trunc("day", "a").alias("start"), (F.date_trunc("day", "z") + day).alias("end"))


def hourly_filled(g: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Hourly rows with the empty hours of the window as zeros; hours outside it stay.

    Without ``bounds`` the window is the whole days from the first hour to the last.
    """
    h = hourly(g)
    h = hour_spine(day_bounds_of(h) if bounds is None else bounds).join(h, "hour", "full_outer")
    zeros = {f.name: 0 for f in h.schema.fields if f.dataType.typeName() in ("long", "double", "integer")}
    return h.fillna(zeros).fillna({"excitement_basis": "none"}).withColumn("hour_end", hour_end(F.col("hour")))


def counts_by(g: DataFrame, column: str, per: str = "hour") -> DataFrame:
    """Flat counts per hour or day of a grain column; empty values are left out."""
    key = F.to_date("hour").alias("date") if per == "date" else F.col("hour")
    return (
        g.where(F.coalesce(F.col(column), F.lit("")) != "")
        .groupBy(key, column)
        .agg(F.sum("events").alias("n"))
    )


# -- words ---------------------------------------------------------------------


def token_grain(journal: DataFrame) -> DataFrame:
    """Count and first sight (time, whole event id, position) of every non-stop token per hour, case kept."""
    spoken = measured(journal.where(F.col("kind") == "speech"))
    # the outer form: no inferred filter that would split the text twice; stop-word test drops its NULLs
    each = F.posexplode_outer(X.tokens(F.col("text"))).alias("pos", "token")
    words = spoken.select("hour", "created_utc", "event_id", each)
    return words.where(~X.is_stop(F.col("token"))).groupBy("hour", "token").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("created_utc", "event_id", "pos")).alias("first_seen"),
    )


def word_counts(tokens: DataFrame, per: str = "hour") -> DataFrame:
    """Lower-cased words per hour or date."""
    return _regroup(tokens.withColumn("word", F.lower("token")), per, "word")


def name_counts(tokens: DataFrame, per: str = "hour") -> DataFrame:
    """Proper-name candidates per hour or date."""
    return _regroup(tokens.where(X.is_name(F.col("token"))).withColumnRenamed("token", "name"), per, "name")


def _regroup(tokens: DataFrame, per: str, out: str) -> DataFrame:
    n = F.sum("n").alias("n")
    if per == "hour":
        return tokens.groupBy("hour", out).agg(n, F.min("first_seen").alias("first_seen"))
    seen = F.min(F.struct("hour", "first_seen")).alias("first_seen")
    return tokens.groupBy(F.to_date("hour").alias("date"), out).agg(n, seen)


def top_k(counts: DataFrame, group: list[str], k: int) -> DataFrame:
    """Most frequent per group, ties by first sight, then by the item itself; adds ``rank``.

    Spark keeps only the best k per group before the shuffle.
    """
    item = [c for c in counts.columns if c not in {*group, "n", "first_seen"}]
    w = Window.partitionBy(*group).orderBy(F.col("n").desc(), "first_seen", *item)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# -- days ----------------------------------------------------------------------


def daily(hours: DataFrame, day: Column | None = None) -> DataFrame:
    """One row per day of (filled) hourly rows, with the most and least exciting hour.

    Equal scores go to the earlier hour.
    """
    key = (F.to_date("hour") if day is None else day).alias("date")
    c = F.col
    hour_info = F.struct("hour", c("excitement_score").alias("score"), c("excitement_basis").alias("basis"))
    epoch = F.unix_seconds("hour")
    total = lambda n: F.sum(n).alias(n)
    return hours.groupBy(key).agg(
        *(total(n) for n in (
            "total_events", "sum_duration_ms", "speech_events", "speech_suppressed_events", "speech_words",
            "speech_chars", "motion_summary_events")),
        (F.sum(F.round(c("speech_seconds") * 1_000_000).cast("bigint")) / F.lit(1e6)).alias("speech_seconds"),
        F.greatest(F.lit(0.0), F.max("motion_peak_score_max")).alias("max_motion_peak_score"),
        F.max_by(hour_info, F.struct(c("excitement_score"), -epoch)).alias("max_hour"),
        F.min_by(hour_info, F.struct(c("excitement_score"), epoch)).alias("min_hour"),
        F.count_if(c("total_events") > 0).alias("hours_with_events"),
        F.count(F.lit(1)).alias("hours"),
    )


def latest_day(journal: DataFrame, tz: str = "UTC") -> DataFrame:
    """One row: UTC bounds of the local day of the newest event."""
    from eventide.functions.times import day_bounds

    newest = journal.agg(F.max("created_utc").alias("newest")).where(F.col("newest").isNotNull())
    start, end = day_bounds(F.col("newest"), tz)
    return newest.select(start.alias("start"), end.alias("end"))


def hour_event_ids(journal: DataFrame) -> DataFrame:
    """Flat (hour, created, event id): an hour's id list as rows, of any length."""
    return journal.where(F.col("event_id").isNotNull() & F.col("created_utc").isNotNull()).select(
        hour_start(F.col("created_utc")).alias("hour"), "created_utc", "event_id"
    )


def iso_hours(hours: DataFrame) -> DataFrame:
    """Hourly rows with ISO text for every time."""
    c = F.col
    return hours.select(
        iso_z(c("hour")).alias("hour_start_utc"),
        iso_z(c("hour_end")).alias("hour_end_utc"),
        "total_events", "unique_sources", "unique_clips", "sum_duration_ms",
        iso_z(c("first_created")).alias("first_event_created_utc"),
        iso_z(c("last_created")).alias("last_event_created_utc"),
        "speech_events", "speech_suppressed_events", "speech_seconds", "speech_words", "speech_chars",
        "motion_summary_events", "motion_peak_score_sum", "motion_peak_score_max", "avg_motion_score",
        "excitement_score", "excitement_basis",
    )
