"""Registered queries over the journal rollups (2.D, C1, C2, C9, F3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventide.functions.times import hour_end, iso_z, quarter_start
from eventide.plans import audit, digests, rollup, sketches, verify
from eventide.queries import tables
from eventide.queries.sql import ISO_Z, journal_sql
from eventide.session import stage

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def _hour():
    return iso_z(F.col("hour")).alias("hour_start_utc")


H = f"strftime(hour, {ISO_Z}) AS hour_start_utc"


def _hours(spark, sf):
    return rollup.hourly_filled(rollup.grain(tables.journal(spark, sf)))


@register("hourly_rollup", journal_sql(f"""
SELECT {H}, strftime(hour + INTERVAL 3599 SECOND, {ISO_Z}) AS hour_end_utc, total_events, unique_sources, unique_clips,
       sum_duration_ms, strftime(first_created, {ISO_Z}) AS first_event_created_utc,
       strftime(last_created, {ISO_Z}) AS last_event_created_utc, speech_events, speech_suppressed_events,
       speech_seconds, speech_words, speech_chars, motion_summary_events, motion_peak_score_sum,
       motion_peak_score_max, m AS avg_motion_score, round(raw_score, 3) AS excitement_score,
       basis AS excitement_basis FROM scored"""))
def hourly_rollup(spark, sf):
    return rollup.iso_hours(_hours(spark, sf))


@register("hourly_counts", journal_sql(f"SELECT {H}, count(*) AS total_events FROM j GROUP BY hour"))
def hourly_counts(spark, sf):
    return rollup.hourly(rollup.grain(tables.journal(spark, sf))).select(_hour(), "total_events")


@register("counts_by_kind", journal_sql(f"SELECT {H}, kind, count(*) AS n FROM j GROUP BY hour, kind"))
def counts_by_kind(spark, sf):
    return rollup.counts_by(rollup.grain(tables.journal(spark, sf)), "kind").select(_hour(), "kind", "n")


@register("counts_by_source", journal_sql(f"SELECT {H}, source, count(*) AS n FROM j GROUP BY hour, source"))
def counts_by_source(spark, sf):
    return rollup.counts_by(rollup.grain(tables.journal(spark, sf)), "source").select(_hour(), "source", "n")


@register("hourly_uniques", journal_sql(f"""
SELECT {H}, count(DISTINCT source) AS unique_sources, count(DISTINCT nullif(clip_id, '')) AS unique_clips
FROM j GROUP BY hour"""))
def hourly_uniques(spark, sf):
    g = rollup.grain(tables.journal(spark, sf))
    return rollup.hourly(g).select(_hour(), F.col("unique_sources").cast("bigint").alias("unique_sources"), "unique_clips")


@register("hourly_duration", journal_sql(f"""
SELECT {H}, CAST(sum(CASE WHEN t1_ms >= t0_ms THEN t1_ms - t0_ms ELSE 0 END) AS BIGINT) AS sum_duration_ms
FROM j GROUP BY hour"""))
def hourly_duration(spark, sf):
    return rollup.hourly(rollup.grain(tables.journal(spark, sf))).select(_hour(), "sum_duration_ms")


@register("first_last", journal_sql(f"""
SELECT {H}, strftime(min(created), {ISO_Z}) AS first_event_created_utc,
       strftime(max(created), {ISO_Z}) AS last_event_created_utc FROM j GROUP BY hour"""))
def first_last(spark, sf):
    h = rollup.hourly(rollup.grain(tables.journal(spark, sf)))
    return h.select(
        _hour(), iso_z(F.col("first_created")).alias("first_event_created_utc"),
        iso_z(F.col("last_created")).alias("last_event_created_utc"),
    )


@register("motion_stats", journal_sql(f"""
SELECT {H}, motion_summary_events, motion_peak_score_sum, motion_peak_score_max, m AS avg_motion_score
FROM scored WHERE total_events > 0"""))
def motion_stats(spark, sf):
    return rollup.hourly(rollup.grain(tables.journal(spark, sf))).select(
        _hour(), "motion_summary_events", "motion_peak_score_sum", "motion_peak_score_max", "avg_motion_score"
    )


@register("speech_stats", journal_sql(f"""
SELECT {H}, speech_events, speech_suppressed_events, speech_seconds, speech_words, speech_chars
FROM scored WHERE total_events > 0"""))
def speech_stats(spark, sf):
    return rollup.hourly(rollup.grain(tables.journal(spark, sf))).select(
        _hour(), "speech_events", "speech_suppressed_events", "speech_seconds", "speech_words", "speech_chars"
    )


@register("word_count_text", journal_sql(
    f"SELECT {H}, lower(token) AS word, count(*) AS n FROM tok GROUP BY hour, lower(token)"))
def word_count_text(spark, sf):
    return rollup.word_counts(rollup.token_grain(tables.journal(spark, sf))).select(_hour(), "word", "n")


_TOP = """
SELECT {head}, {item}, n, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY n DESC, seen) AS rank FROM (
    SELECT {group}, {expr} AS {item}, count(*) AS n, min((created, event_id, pos)) AS seen
    FROM (SELECT *, CAST(hour AS DATE) AS date FROM tok) {where} GROUP BY ALL)) WHERE rank <= {k}"""
_NAME = r"WHERE regexp_matches(token, '^\p{Lu}') AND upper(token) <> token"


@register("top_words_hour", journal_sql(
    _TOP.format(head=H, item="word", group="hour", expr="lower(token)", where="", k=3)))
def top_words_hour(spark, sf):
    words = rollup.word_counts(rollup.token_grain(tables.journal(spark, sf)))
    return rollup.top_k(words, ["hour"], 3).select(_hour(), "word", "n", F.col("rank").cast("bigint").alias("rank"))


@register("top_names_hour", journal_sql(
    _TOP.format(head=H, item="name", group="hour", expr="token", where=_NAME, k=3)))
def top_names_hour(spark, sf):
    names = rollup.name_counts(rollup.token_grain(tables.journal(spark, sf)))
    return rollup.top_k(names, ["hour"], 3).select(_hour(), "name", "n", F.col("rank").cast("bigint").alias("rank"))


_D = "strftime(date, '%Y-%m-%d') AS date_utc"


@register("day_top_word", journal_sql(
    _TOP.format(head=_D, item="word", group="date", expr="lower(token)", where="", k=1)))
def day_top_word(spark, sf):
    words = rollup.word_counts(rollup.token_grain(tables.journal(spark, sf)), "date")
    return rollup.top_k(words, ["date"], 1).select(
        F.date_format("date", "yyyy-MM-dd").alias("date_utc"), "word", "n", F.col("rank").cast("bigint").alias("rank"))


@register("day_top_name", journal_sql(
    _TOP.format(head=_D, item="name", group="date", expr="token", where=_NAME, k=1)))
def day_top_name(spark, sf):
    names = rollup.name_counts(rollup.token_grain(tables.journal(spark, sf)), "date")
    return rollup.top_k(names, ["date"], 1).select(
        F.date_format("date", "yyyy-MM-dd").alias("date_utc"), "name", "n", F.col("rank").cast("bigint").alias("rank"))


@register("hourly_score", journal_sql(
    f"SELECT {H}, raw_score AS score, basis AS excitement_basis FROM scored"))
def hourly_score(spark, sf):
    raw = F.col("avg_motion_score") * 100.0 + F.col("speech_seconds")  # before rounding
    return _hours(spark, sf).select(_hour(), raw.alias("score"), "excitement_basis")


@register("hour_spine", journal_sql(
    f"SELECT {H}, strftime(hour + INTERVAL 3599 SECOND, {ISO_Z}) AS hour_end_utc, total_events FROM hourly"))
def hour_spine(spark, sf):
    return _hours(spark, sf).select(_hour(), iso_z(hour_end(F.col("hour"))).alias("hour_end_utc"), "total_events")


@register("daily_totals", journal_sql("""
SELECT strftime(hour, '%Y-%m-%d') AS date_utc, CAST(sum(total_events) AS BIGINT) AS total_events,
       CAST(sum(sum_duration_ms) AS BIGINT) AS sum_duration_ms, CAST(sum(speech_events) AS BIGINT) AS speech_events,
       CAST(sum(speech_suppressed_events) AS BIGINT) AS speech_suppressed_events,
       CAST(sum(CAST(speech_seconds * 1000 AS BIGINT)) AS BIGINT) / 1000.0::DOUBLE AS speech_seconds,
       CAST(sum(speech_words) AS BIGINT) AS speech_words, CAST(sum(speech_chars) AS BIGINT) AS speech_chars,
       CAST(sum(motion_summary_events) AS BIGINT) AS motion_summary_events,
       max(motion_peak_score_max) AS max_motion_peak_score
FROM scored GROUP BY 1"""))
def daily_totals(spark, sf):
    return rollup.daily(_hours(spark, sf)).select(
        F.date_format("date", "yyyy-MM-dd").alias("date_utc"), "total_events", "sum_duration_ms", "speech_events",
        "speech_suppressed_events", "speech_seconds", "speech_words", "speech_chars", "motion_summary_events",
        "max_motion_peak_score",
    )


@register("daily_counts_by_kind", journal_sql(
    "SELECT strftime(hour, '%Y-%m-%d') AS date_utc, kind, count(*) AS n FROM j GROUP BY 1, 2"))
def daily_counts_by_kind(spark, sf):
    g = rollup.grain(tables.journal(spark, sf))
    return rollup.counts_by(g, "kind", "date").select(F.date_format("date", "yyyy-MM-dd").alias("date_utc"), "kind", "n")


@register("busiest_quietest_hour", journal_sql(f"""
SELECT strftime(d, '%Y-%m-%d') AS date_utc, strftime(hi.hour, {ISO_Z}) AS max_hour, hi.basis AS max_basis,
       strftime(lo.hour, {ISO_Z}) AS min_hour, lo.basis AS min_basis
FROM (SELECT date_trunc('day', hour) AS d,
             first({{'hour': hour, 'basis': basis}} ORDER BY round(raw_score, 3) DESC, hour) AS hi,
             first({{'hour': hour, 'basis': basis}} ORDER BY round(raw_score, 3), hour) AS lo
      FROM scored GROUP BY 1)"""))
def busiest_quietest_hour(spark, sf):
    c = F.col
    return rollup.daily(_hours(spark, sf)).select(
        F.date_format("date", "yyyy-MM-dd").alias("date_utc"),
        iso_z(c("max_hour.hour")).alias("max_hour"), c("max_hour.basis").alias("max_basis"),
        iso_z(c("min_hour.hour")).alias("min_hour"), c("min_hour.basis").alias("min_basis"),
    )


@register("hour_event_ids", journal_sql(f"SELECT {H}, event_id FROM j"))
def hour_event_ids(spark, sf):
    return rollup.hour_event_ids(tables.journal(spark, sf)).select(_hour(), "event_id")


@register("latest_day", journal_sql(f"""
SELECT strftime(date_trunc('day', max(created)), {ISO_Z}) AS window_start_utc,
       strftime(date_trunc('day', max(created)) + INTERVAL 86399 SECOND, {ISO_Z}) AS window_end_utc FROM j"""))
def latest_day(spark, sf):
    d = rollup.latest_day(tables.journal(spark, sf))
    return d.select(iso_z(F.col("start")).alias("window_start_utc"), iso_z(F.col("end")).alias("window_end_utc"))


def _ids_and_journal(spark, sf):
    """Ids of the whole journal, checked against one that lacks the suppressed speech and the errors."""
    j = tables.journal(spark, sf)
    return rollup.hour_event_ids(j), j.where(~F.col("kind").isin("speech.suppressed", "error"))


_KNOWN = "kind NOT IN ('speech.suppressed', 'error')"


@register("verify_missing", journal_sql(f"SELECT DISTINCT event_id FROM j WHERE NOT ({_KNOWN})"))
def verify_missing(spark, sf):
    return verify.missing_ids(*_ids_and_journal(spark, sf))


@register("verify_present", journal_sql(f"SELECT DISTINCT event_id FROM j WHERE {_KNOWN}"))
def verify_present(spark, sf):
    return verify.present_ids(*_ids_and_journal(spark, sf))


@register("verify_totals", journal_sql(f"""
SELECT count(DISTINCT event_id) AS checked_event_ids,
       count(DISTINCT event_id) FILTER (WHERE NOT ({_KNOWN})) AS missing_event_ids FROM j"""))
def verify_totals(spark, sf):
    return verify.verification(*_ids_and_journal(spark, sf)).select("checked_event_ids", "missing_event_ids")


_LOST = "kind = 'error' AND CAST(created AS DATE) IN (DATE '2024-01-07', DATE '2024-01-19')"


@register("verify_digests", journal_sql(f"""
SELECT count(*) AS checked_event_ids, count(*) FILTER (WHERE {_LOST}) AS missing_event_ids,
       (SELECT string_agg(event_id, ',' ORDER BY event_id) FROM (SELECT event_id FROM j WHERE {_LOST} ORDER BY event_id LIMIT 20)) AS sample FROM j"""))
def verify_digests(spark, sf):
    """The journal's ids against a journal that lost the errors of two days: only the hours that differ are joined."""
    j = tables.journal(spark, sf).select("event_id", "kind", "created_utc")
    lost = (F.col("kind") == "error") & F.to_date("created_utc").isin("2024-01-07", "2024-01-19")
    left = j.where(~lost)
    out = digests.verification(j, left, stage(digests.hour_digests(j)), stage(digests.hour_digests(left)))
    return out.select("checked_event_ids", "missing_event_ids", F.array_join("missing_ids_sample", ",").alias("sample"))


@register("distinct_sketches", journal_sql("""
SELECT strftime(hour, '%Y-%m-%d') AS date_utc, count(DISTINCT source) AS unique_sources, count(DISTINCT nullif(clip_id, '')) AS unique_clips
FROM j GROUP BY 1"""))
def distinct_sketches(spark, sf):
    """Distinct sources and clips of each day, from the sketches of its hours."""
    s = sketches.hour_sketches(rollup.grain(tables.journal(spark, sf)))
    return sketches.distincts(s, F.date_format("hour", "yyyy-MM-dd").alias("date_utc"))


@register("verify_sample", journal_sql(
    f"SELECT DISTINCT event_id FROM j WHERE NOT ({_KNOWN}) ORDER BY event_id LIMIT 20"))
def verify_sample(spark, sf):
    return verify.missing_sample(*_ids_and_journal(spark, sf))


@register("window_row_count", journal_sql("""
SELECT count(*) AS db_count_in_window FROM j
WHERE created BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-11 23:59:59'"""))
def window_row_count(spark, sf):
    return verify.count_in_window(
        tables.journal(spark, sf), F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-11 23:59:59").cast("timestamp"))


@register("table_audit", journal_sql("""
SELECT 'captions' AS table_name, count(*) AS row_count, count(DISTINCT event_id) AS distinct_keys,
       count(*) FILTER (WHERE created IS NULL) AS null_times FROM j WHERE kind LIKE 'speech%'
UNION ALL SELECT 'clips', count(*), count(DISTINCT clip_id), 0 FROM (SELECT DISTINCT clip_id FROM j WHERE clip_id <> '')
UNION ALL SELECT 'events', count(*), count(DISTINCT event_id), count(*) FILTER (WHERE created IS NULL) FROM j"""))
def table_audit(spark, sf):
    j = tables.journal(spark, sf)
    clips = j.where(F.col("clip_id") != "").select("clip_id").distinct()
    return audit.journal_audit(j, clips, j.where(F.col("kind").startswith("speech")))


@register("quarter_hour", journal_sql(f"""
SELECT strftime(time_bucket(INTERVAL 15 MINUTE, created), {ISO_Z}) AS quarter_start_utc, count(*) AS n
FROM j GROUP BY 1"""))
def quarter_hour(spark, sf):
    q = quarter_start(F.col("created_utc"))
    return tables.journal(spark, sf).groupBy(q.alias("q")).agg(F.count(F.lit(1)).alias("n")).select(
        iso_z(F.col("q")).alias("quarter_start_utc"), "n")
