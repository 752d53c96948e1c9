"""Nested hourly and daily documents, and the summarise job."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.functions.times import day_bounds, iso_z
from eventide.plans import rollup, verify
from eventide.session import require_utc, scratch, stage
from eventide.sources import journal as J

IDS = "hour timestamp, created_utc timestamp, event_id string"
IDS_TABLE = "hour_ids"


def _as_map(counts: DataFrame, group: str, key: str, out: str) -> DataFrame:
    """Flat counts to one sorted map per group; entries are distinct keys, counted before."""
    pairs = F.array_sort(F.collect_list(F.struct(key, "n")))
    return counts.groupBy(group).agg(F.map_from_entries(pairs).alias(out))


def _as_list(top: DataFrame, group: str, item: str, out: str) -> DataFrame:
    """Ranked rows (at most k a group) to one list per group."""
    rows = F.array_sort(F.collect_list(F.struct("rank", item, F.col("n").alias("count"))))
    return top.groupBy(group).agg(
        F.transform(rows, lambda r: F.struct(r[item].alias(item), r["count"].alias("count"))).alias(out)
    )


def hourly_documents(hours: DataFrame, g: DataFrame, tokens: DataFrame) -> DataFrame:
    """One row per hour with the fields of an hourly JSON document.

    ``event_ids`` says how many ids the hour has and where they are: as rows of
    the table ``hour_ids`` beside the documents, whatever their number.
    """
    docs = (
        hours.join(_as_map(rollup.counts_by(g, "kind"), "hour", "kind", "counts_by_kind"), "hour", "left")
        .join(_as_map(rollup.counts_by(g, "source"), "hour", "source", "counts_by_source"), "hour", "left")
        .join(_as_list(rollup.top_k(rollup.word_counts(tokens), ["hour"], 3), "hour", "word", "top_words"), "hour", "left")
        .join(_as_list(rollup.top_k(rollup.name_counts(tokens), ["hour"], 3), "hour", "name", "top_proper_names"), "hour", "left")
    )
    fields = [
        iso_z(F.col("hour")).alias("hour_start_utc"), iso_z(F.col("hour_end")).alias("hour_end_utc"), "total_events",
        _or_empty("counts_by_kind", "map<string,bigint>"), _or_empty("counts_by_source", "map<string,bigint>"),
        "unique_sources", "unique_clips", "sum_duration_ms",
        iso_z(F.col("first_created")).alias("first_event_created_utc"),
        iso_z(F.col("last_created")).alias("last_event_created_utc"),
        F.struct(
            F.col("total_events").alias("count"), F.lit(IDS_TABLE).alias("table"),
            F.date_format("hour", "yyyy-MM-dd").alias("date"), F.date_format("hour", "HH").alias("hh"),
        ).alias("event_ids"),
    ]
    return docs.select(
        "hour", *fields,
        "speech_events", "speech_suppressed_events", "speech_seconds", "speech_words", "speech_chars",
        "motion_summary_events", "motion_peak_score_sum", "motion_peak_score_max", "excitement_score",
        "excitement_basis",
        _or_empty("top_words", "array<struct<word:string,count:bigint>>"),
        _or_empty("top_proper_names", "array<struct<name:string,count:bigint>>"),
        "avg_motion_score",
    )


def _or_empty(name: str, type_: str) -> Column:
    empty = F.create_map() if type_.startswith("map") else F.array()
    return F.coalesce(F.col(name).cast(type_), empty.cast(type_)).alias(name)


def daily_documents(
    hours: DataFrame, docs: DataFrame, g: DataFrame, tokens: DataFrame, bounds: DataFrame, verified: DataFrame
) -> DataFrame:
    """The summary document of one window, dated by its first day.

    Holds day totals, the extreme hours, the day's word and name, the hour
    documents and the outcome of the id check.  A window has a bounded number
    of hours, so collecting them in one row is safe.
    """
    one = F.lit(1).alias("_w")
    info = lambda h: F.when(F.col(h).isNotNull(), F.struct(
        iso_z(F.col(f"{h}.hour")).alias("hour_start_utc"), iso_z(rollup.hour_end(F.col(f"{h}.hour"))).alias("hour_end_utc"),
        F.col(f"{h}.score").alias("score"), F.col(f"{h}.basis").alias("basis")))
    totals = rollup.daily(hours, F.lit(1)).withColumnRenamed("date", "_w")
    whole = lambda df: df.withColumn("_w", F.lit(1))

    def counts(column: str, out: str) -> DataFrame:
        flat = rollup.counts_by(g, column).groupBy(one, column).agg(F.sum("n").alias("n"))
        return _as_map(flat, "_w", column, out)

    def top(counts_: DataFrame, item: str) -> DataFrame:
        merged = counts_.groupBy(one, item).agg(F.sum("n").alias("n"), F.min(F.struct("hour", "first_seen")).alias("first_seen"))
        return rollup.top_k(merged, ["_w"], 1).select("_w", item, F.col("n").alias(f"{item}_n"))

    rows = F.collect_list(F.struct("hour", F.struct(*[c for c in docs.columns if c != "hour"]).alias("doc")))
    # documents hold maps, which have no order: compare the hours only
    by_hour = lambda x, y: F.when(x["hour"] < y["hour"], -1).when(x["hour"] > y["hour"], 1).otherwise(0)
    hour_list = F.transform(F.array_sort(rows, by_hour), lambda r: r["doc"])
    c = F.col
    joined = whole(bounds)
    for part in (
        totals, counts("kind", "counts_by_kind"), counts("source", "counts_by_source"),
        top(rollup.word_counts(tokens), "word"), top(rollup.name_counts(tokens), "name"),
        whole(docs).groupBy("_w").agg(hour_list.alias("hours_list")), whole(verified),
    ):
        joined = joined.join(part, "_w", "left")
    return joined.select(
        F.date_format("start", "yyyy-MM-dd").alias("date_utc"),
        iso_z(c("start")).alias("window_start_utc"), iso_z(c("end")).alias("window_end_utc"),
        "total_events", _or_empty("counts_by_kind", "map<string,bigint>"),
        _or_empty("counts_by_source", "map<string,bigint>"), "sum_duration_ms", c("hours_list").alias("hours"),
        F.struct("speech_events", "speech_suppressed_events", F.round("speech_seconds", 3).alias("speech_seconds"),
                 "speech_words", "speech_chars").alias("speech"),
        F.struct("motion_summary_events", F.round("max_motion_peak_score", 3).alias("max_motion_peak_score")).alias("motion"),
        F.struct(info("max_hour").alias("max_hour"), info("min_hour").alias("min_hour")).alias("excitement_daily"),
        F.struct(
            c("word").alias("most_common_word"), F.coalesce("word_n", F.lit(0)).alias("most_common_word_count"),
            c("name").alias("most_common_proper_name"),
            F.coalesce("name_n", F.lit(0)).alias("most_common_proper_name_count")).alias("lexical"),
        F.struct(*[n for n in verified.columns]).alias("verification"),
    )


def verification_row(ids: DataFrame, journal: DataFrame, start: Column, end: Column) -> DataFrame:
    """Check result of a document; without ids the window's row count stands in.  Only the window's dates are read."""
    dates = F.col(J.DATE).between(F.to_date(start), F.to_date(end))
    found = verify.verification(ids.withColumnRenamed("date", J.DATE), journal.where(dates))
    in_window = verify.count_in_window(journal, start, end)
    return found.select(
        "checked_event_ids", "missing_event_ids", "missing_ids_sample",
        F.when(F.col("checked_event_ids") == 0, in_window.scalar()).alias("db_count_in_window"),
    )


def resolve_window(
    spark: SparkSession, newest: DataFrame, date: str | None = None, start: str | None = None, end: str | None = None,
    tz: str = "UTC",
) -> tuple[dt.datetime, dt.datetime] | None:
    """UTC bounds: a given day, given start and end, or the day of the newest event; None without events.

    ``newest`` is any part of the journal that holds its newest event.
    """
    if date:
        s, e = day_bounds(F.lit(date).cast("timestamp"), "UTC")
    elif start and end:
        from eventide.functions.times import parse_ts

        s, e = parse_ts(F.lit(start)), parse_ts(F.lit(end))
    else:
        row = rollup.latest_day(newest, tz).select(F.unix_seconds("start"), F.unix_seconds("end")).first()
        return None if row is None else tuple(dt.datetime.fromtimestamp(v, dt.timezone.utc) for v in row)
    row = spark.range(1).select(F.unix_seconds(s), F.unix_seconds(e)).first()
    return tuple(dt.datetime.fromtimestamp(v, dt.timezone.utc) for v in row)


def summarize(
    spark: SparkSession, journal_root: str, out_root: str, date: str | None = None, start: str | None = None,
    end: str | None = None, tz: str = "UTC",
) -> tuple[dt.datetime, dt.datetime] | None:
    """Write the hourly and daily documents of a window; re-running replaces them.

    The grain and the tokens (small) are written to the shared folder first and
    every document is built from those, so the journal is scanned once for each.
    ``hour_ids/`` is replaced hour by hour; an hour that the window only touches
    keeps the ids it has outside the window.
    """
    require_utc(spark)
    journal = J.events(spark, journal_root)
    window = resolve_window(spark, J.newest_part(spark, journal_root), date, start, end, tz)
    if window is None:
        return None
    with scratch(spark):
        _summarize(spark, journal, window, out_root)
    return window


def _summarize(spark: SparkSession, journal: DataFrame, window: tuple[dt.datetime, dt.datetime], out_root: str) -> None:
    lo, hi = (F.lit(w) for w in window)
    events = J.scan_window(journal, lo, hi)
    g, tokens = stage(rollup.grain(events)), stage(rollup.token_grain(events))

    bounds = rollup.one_row(spark, *window)
    hours = rollup.hourly_filled(g, bounds)
    # whole hours: those at the window's ends may reach over it
    full = J.scan_window(journal, F.date_trunc("hour", lo), rollup.hour_end(F.date_trunc("hour", hi)))
    ids = rollup.hour_event_ids(full).withColumns({"date": F.to_date("hour"), "hh": F.date_format("hour", "HH")})
    ids.hint("rebalance", F.col("date"), F.col("hh")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("date", "hh").parquet(f"{out_root}/{IDS_TABLE}")
    docs = hourly_documents(hours, g, tokens)
    # a window has few hours; one sorted file, replaced as a whole
    docs.orderBy("hour").drop("hour").coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{out_root}/hourly")

    # the check reads back what was written: the ids table against the journal
    written = spark.read.schema(f"{IDS}, date date, hh string").parquet(f"{out_root}/{IDS_TABLE}").where(
        F.col("date").between(F.to_date(lo), F.to_date(hi)) & F.col("created_utc").between(lo, hi))
    checked = verification_row(written, journal, lo, hi)
    day = daily_documents(hours, docs, g, tokens, bounds, checked)
    day.withColumn("date", F.col("date_utc")).write.mode("overwrite").option("ignoreNullFields", "false").option(
        "partitionOverwriteMode", "dynamic").partitionBy("date").json(f"{out_root}/daily")
