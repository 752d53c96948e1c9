"""Registered queries over trends (2.L) and windowed batch forms of 2.H."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventide.functions.times import iso_z
from eventide.operators import near_text, trailing
from eventide.operators import sessions as session
from eventide.params import TrendParams
from eventide.plans import rollup, shifts, trends
from eventide.queries import tables
from eventide.queries.perception import NOVELTY, NOVELTY_SQL, _tracks, lanes_sql
from eventide.queries.sql import EVENTS, ISO_Z, events_sql, journal_sql, turns_sql
from eventide.streaming import windows

QUERIES: dict = {}
SQL: dict[str, str] = {}
PARAMS = TrendParams(z_threshold=2.0, mix_threshold=0.1, caption_similarity=0.2)


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


DAYS = """
dm AS (SELECT CAST(hour AS DATE) AS date, count(*) AS total_events,
         count(*) FILTER (WHERE kind LIKE 'motion%') / count(*) AS motion_share,
         count(*) FILTER (WHERE kind LIKE 'track%' OR kind LIKE 'object%') / count(*) AS object_share, count(DISTINCT hour) / 24.0::DOUBLE AS uptime
       FROM j GROUP BY 1),
dys AS (SELECT d.date, coalesce(total_events, 0) AS total_events, motion_share, uptime FROM (
         SELECT CAST(unnest(generate_series((SELECT min(date) FROM dm), (SELECT max(date) FROM dm), INTERVAL 1 DAY)) AS DATE) AS date) d
       LEFT JOIN dm USING (date)),
bl AS (SELECT *, count(*) FILTER (WHERE total_events > 0) OVER w AS nb,
         avg(total_events) FILTER (WHERE total_events > 0) OVER w AS mean,
         stddev_pop(total_events) FILTER (WHERE total_events > 0) OVER w AS sd,
         max(date) FILTER (WHERE total_events > 0) OVER w AS newest
       FROM dys WINDOW w AS (ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))"""
_STATE = "CASE WHEN nb < 3 THEN 'cold' WHEN date - newest > 2 THEN 'stale' ELSE 'ready' END"
_DATE = "strftime(date, '%Y-%m-%d') AS date_utc"


def trend_sql(select: str, ctes: str = DAYS) -> str:
    head = journal_sql("")
    return f"{head.rstrip()}, {ctes} {select}"


def _date():
    return F.date_format("date", "yyyy-MM-dd").alias("date_utc")


def _days(spark, sf):
    return trends.fill_days(trends.day_metrics(rollup.grain(tables.journal(spark, sf))))


@register("day_metrics", trend_sql(f"""
SELECT {_DATE}, total_events, round(motion_share, 9) AS motion_share, round(object_share, 9) AS object_share, uptime,
       1 - uptime AS downtime, round(dup, 9) AS duplicate_rate FROM dm LEFT JOIN (
  SELECT CAST(ts AS DATE) AS date, count(*) FILTER (WHERE value < 25) / count(*) AS dup FROM ev GROUP BY 1) USING (date)"""))
def day_metrics(spark, sf):
    """Small values stand for frames that novelty called duplicates."""
    labels = tables.events(spark, sf).select(
        "ts", F.when(F.col("value") < 25, "duplicate").otherwise("new").alias("novelty"))
    d = trends.day_metrics(rollup.grain(tables.journal(spark, sf)), labels)
    r = lambda c: F.round(c, 9).alias(c)
    return d.select(_date(), "total_events", r("motion_share"), r("object_share"), "uptime", "downtime", r("duplicate_rate"))


@register("rolling_baseline", trend_sql(f"""
SELECT {_DATE}, nb AS baseline_days, round(mean, 6) AS baseline_mean, round(sd, 6) AS baseline_std, {_STATE} AS baseline_state FROM bl"""))
def rolling_baseline(spark, sf):
    b = trends.baselines(_days(spark, sf), PARAMS)
    r = lambda c: F.round(c, 6).alias(c)
    return b.select(_date(), "baseline_days", r("baseline_mean"), r("baseline_std"), "baseline_state")


@register("anomaly_flags", trend_sql(f"""
SELECT {_DATE}, round((total_events - mean) / greatest(sd, 1e-9), 4) AS z, CASE WHEN {_STATE} <> 'ready' THEN NULL WHEN (total_events - mean) / greatest(sd, 1e-9) >= 2 THEN 'spike'
       WHEN (total_events - mean) / greatest(sd, 1e-9) <= -2 THEN 'drop' END AS flag FROM bl"""))
def anomaly_flags(spark, sf):
    return trends.activity_flags(trends.baselines(_days(spark, sf), PARAMS), PARAMS).select(
        _date(), F.round("z", 4).alias("z"), "flag")


@register("missing_motion", trend_sql(f"""
SELECT {_DATE}, total_events > 0 AND coalesce(motion_share, 0) = 0
       AND coalesce(lag(motion_share) OVER (ORDER BY date), 0) > 0 AS missing_motion FROM dys"""))
def missing_motion(spark, sf):
    return trends.missing_motion(_days(spark, sf)).select(_date(), "missing_motion")


@register("mix_shift", trend_sql(f"""
SELECT strftime(a.date, '%Y-%m-%d') AS date_utc, round(sum(abs(coalesce(x.s, 0) - coalesce(y.s, 0))) / 2, 9) AS mix_distance,
       sum(abs(coalesce(x.s, 0) - coalesce(y.s, 0))) / 2 >= {PARAMS.mix_threshold} AS mix_shift
FROM dm a JOIN dm b ON b.date = a.date - 1 CROSS JOIN (SELECT DISTINCT kind FROM j) k
LEFT JOIN sh x ON x.date = a.date AND x.kind = k.kind LEFT JOIN sh y ON y.date = b.date AND y.kind = k.kind GROUP BY 1""",
    DAYS + """, sh AS (SELECT CAST(hour AS DATE) AS date, kind, count(*) / sum(count(*)) OVER (PARTITION BY CAST(hour AS DATE)) AS s
              FROM j GROUP BY 1, 2)"""))
def mix_shift(spark, sf):
    kinds = rollup.counts_by(rollup.grain(tables.journal(spark, sf)), "kind", "date")
    return trends.mix_shift(kinds, PARAMS).select(
        _date(), F.round("mix_distance", 9).alias("mix_distance"), "mix_shift")


@register("week_over_week", trend_sql(f"""
SELECT strftime(a.date, '%Y-%m-%d') AS date_utc, a.total_events, b.total_events AS week_ago,
       a.total_events - b.total_events AS change, round(a.total_events / nullif(b.total_events, 0), 9) AS ratio FROM dys a LEFT JOIN dys b ON b.date = a.date - 7"""))
def week_over_week(spark, sf):
    return trends.week_over_week(_days(spark, sf)).select(
        _date(), "total_events", "week_ago", "change", F.round("ratio", 9).alias("ratio"))


@register("quarter_counts", journal_sql(f"""
SELECT source, strftime(time_bucket(INTERVAL 15 MINUTE, created), {ISO_Z}) AS quarter, count(*) AS events FROM j GROUP BY 1, 2"""))
def quarter_counts(spark, sf):
    return trends.quarter_counts(tables.journal(spark, sf)).select("source", iso_z(F.col("quarter")).alias("quarter"), "events")


@register("still_bursts", events_sql(f"""
SELECT camera, strftime(date_trunc('second', ts), {ISO_Z}) AS burst_start,
       string_agg(CAST(event_id AS VARCHAR), '|' ORDER BY ts, CAST(event_id AS VARCHAR)) AS paths FROM ev GROUP BY 1, 2"""))
def still_bursts(spark, sf):
    """Events as stills, in bursts of a second."""
    e = tables.events(spark, sf).select("camera", "ts", F.col("event_id").cast("string").alias("path"))
    b = trends.still_bursts(e)
    return b.select("camera", iso_z(F.col("burst_start")).alias("burst_start"), F.array_join("paths", "|").alias("paths"))


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_'']+'), lambda w: w <> ''))"


@register("near_dup_captions", turns_sql(f"""
SELECT conv_id, turn, round(CASE WHEN b IS NULL THEN NULL WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0
         ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 9) AS similarity,
       b IS NOT NULL AND CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN true
         ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) >= {PARAMS.caption_similarity} END AS repeat
FROM (SELECT conv_id, turn, a, lag(a) OVER (PARTITION BY source ORDER BY ts, turn) AS b FROM w)""",
    f"w AS (SELECT conv_id, turn, source, ts, {_WORDS} AS a FROM tn)"))
def near_dup_captions(spark, sf):
    t = tables.turns(spark, sf).withColumn("source", F.concat(F.lit("mic_"), F.col("conv_id") % 4))
    out = trends.caption_repeats(t, PARAMS, ["source"], ["ts", "turn"], 86400.0)
    return out.select("conv_id", "turn", F.round("similarity", 9).alias("similarity"), "repeat")


@register("audible_speech", turns_sql("SELECT conv_id, turn FROM tn WHERE spoken_s >= 0.5"))
def audible_speech(spark, sf):
    s = (F.unix_seconds("end_ts") - F.unix_seconds("ts")).alias("speech_s")
    return trends.audible(tables.turns(spark, sf).select("conv_id", "turn", s), PARAMS).select("conv_id", "turn")


@register("retention", journal_sql("""
SELECT event_id FROM j WHERE CAST(created AS DATE) > (SELECT max(CAST(created AS DATE)) FROM j) - 7"""))
def retention(spark, sf):
    """The last seven days, seen from the newest event."""
    j = tables.journal(spark, sf).withColumn("created_date", F.to_date("created_utc"))
    today = j.agg(F.max("created_date")).scalar()
    return trends.retained(j, today, PARAMS).select("event_id")


@register("recent_digest", journal_sql(f"""
SELECT strftime(hour, {ISO_Z}) || ': ' || total_events || ' events; ' || motion_summary_events || ' motion, ' ||
       speech_events || ' speech' || coalesce('; words ' || w, '') AS line
FROM (SELECT * FROM hourly WHERE total_events > 0 ORDER BY hour DESC LIMIT 3) LEFT JOIN (
  SELECT hour, string_agg(word, ', ' ORDER BY r) AS w FROM (
    SELECT hour, word, row_number() OVER (PARTITION BY hour ORDER BY n DESC, seen) AS r FROM (
      SELECT hour, lower(token) AS word, count(*) AS n, min((created, event_id, pos)) AS seen FROM tok GROUP BY 1, 2))
  WHERE r <= 3 GROUP BY hour) USING (hour)"""))
def recent_digest(spark, sf):
    j = tables.journal(spark, sf)
    words = rollup.top_k(rollup.word_counts(rollup.token_grain(j)), ["hour"], 3)
    return trends.digest(rollup.hourly(rollup.grain(j)), words).select("line")


@register("dwell", lanes_sql(f"""
SELECT camera, strftime(date_trunc('hour', to_timestamp(enter_s)::TIMESTAMP), {ISO_Z}) AS hour, cls, count(*) AS tracks,
       sum(dur) AS dwell_s FROM tw WHERE enter_s IS NOT NULL AND exit_s IS NOT NULL GROUP BY ALL"""))
def dwell(spark, sf):
    """Dwell per hour and class of the tracks in lanes."""

    return trends.dwell(_tracks(spark, sf)).select("camera", iso_z(F.col("hour")).alias("hour"), "cls", "tracks", "dwell_s")


@register("sessions", f"""WITH {EVENTS},
g AS (SELECT camera, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS brk FROM ev
      WINDOW w AS (PARTITION BY camera ORDER BY ts)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY camera ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT camera, strftime(min(ts), {ISO_Z}) AS session_start, strftime(max(ts), {ISO_Z}) AS session_last, count(*) AS events FROM s GROUP BY camera, n""")
def sessions(spark, sf):
    """Sessions with a gap of 20 minutes: the usual approximation of bursts."""
    e = tables.events(spark, sf).select("camera", "ts", "event_id")
    out = session.sessions(e, ["camera"], ["ts", "event_id"], 1200.0, 86400.0)
    z = lambda n: iso_z(F.col(n)).alias(n)
    return out.select("camera", z("session_start"), z("session_last"), "events")


@register("stale_sources", trend_sql("""
SELECT strftime(date, '%Y-%m-%d') AS date_utc, known_sources, stale_sources, stale_sources / known_sources AS stale_rate FROM (
  SELECT date, count(*) AS known_sources, count(*) FILTER (age > 0) AS stale_sources FROM (
    SELECT day + age::INTEGER AS date, source, min(age) AS age FROM (SELECT DISTINCT CAST(hour AS DATE) AS day, source FROM j), range(8) r(age)
    GROUP BY 1, 2) GROUP BY 1) WHERE stale_sources < known_sources"""))
def stale_sources(spark, sf):
    return shifts.stale_sources(rollup.grain(tables.journal(spark, sf)), PARAMS).select(
        _date(), "known_sources", "stale_sources", "stale_rate")


def shift_ctes(values: str, back: int = 7, least: int = 3) -> str:
    """The same distance on exact quantiles: ``values`` has period and value."""
    q = lambda t: (
        f"SELECT period, v[(i * n + {shifts.GRID - 1}) // {shifts.GRID}] AS x FROM (SELECT *, unnest(range(1, {shifts.GRID + 1})) AS i FROM {t})")
    return f"""
v AS ({values}),
a AS (SELECT period, count(*) AS n, list_sort(list(value)) AS v FROM v GROUP BY 1),
b AS (SELECT a.period, count(DISTINCT v.period) AS days, count(v.value) AS n, list_sort(list(v.value) FILTER (v.value IS NOT NULL)) AS v
      FROM a LEFT JOIN v ON v.period BETWEEN a.period - {back} AND a.period - 1 GROUP BY 1),
ready AS (SELECT * FROM b WHERE days >= {least}),
lv AS (SELECT period, x, sum(s) AS s FROM (
         SELECT *, 1 AS s FROM ({q('a')}) UNION ALL SELECT *, -1 FROM ({q('ready')})) WHERE period IN (SELECT period FROM ready) GROUP BY 1, 2),
far AS (SELECT period, max(abs(c)) / {shifts.GRID} AS distance FROM (
        SELECT period, sum(s) OVER (PARTITION BY period ORDER BY x ROWS UNBOUNDED PRECEDING) AS c FROM lv) GROUP BY 1)"""


SHIFTS = f"""
SELECT period, a.n AS n, days AS base_periods, b.n AS base_n, distance, distance >= {PARAMS.shift_threshold} AS shift
FROM a JOIN b USING (period) LEFT JOIN far USING (period)"""


@register("confidence_shift", events_sql(SHIFTS, shift_ctes(
    "SELECT CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS BIGINT) AS period, motion AS value FROM ev")))
def confidence_shift(spark, sf):
    """Scores of each day against those of the week before."""
    day = F.date_diff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long")
    return shifts.value_shift(tables.events(spark, sf).select(day.alias("period"), F.col("motion").alias("value")), "period", PARAMS)


@register("novelty_shift", f"WITH {NOVELTY_SQL}, " + shift_ctes(
    "SELECT 28401120 + vec_id // 60 AS period, dist::DOUBLE AS value FROM d") + SHIFTS)
def novelty_shift(spark, sf):
    """Hash distances of each minute against those of the seven minutes before."""
    n = trailing.novelty(tables.hashed_frames(spark, sf), NOVELTY)
    minute = F.floor(F.unix_seconds("ts") / 60).cast("long").alias("period")
    return shifts.value_shift(n.select(minute, F.col("hash_distance").cast("double").alias("value")), "period", PARAMS)


@register("caption_groups", f"""
WITH RECURSIVE tn0 AS (SELECT conv_id * 100000 + turn AS id, {_WORDS} AS w FROM conversations WHERE text IS NOT NULL),
lk AS (SELECT x.id AS a, y.id AS b FROM tn0 x JOIN tn0 y ON x.id <> y.id
       AND CASE WHEN len(x.w) = 0 AND len(y.w) = 0 THEN true
           ELSE len(list_intersect(x.w, y.w)) >= {PARAMS.caption_similarity} * len(list_distinct(list_concat(x.w, y.w))) END),
r AS (SELECT id, id AS other FROM tn0 UNION SELECT r.id, lk.b FROM r JOIN lk ON lk.a = r.other)
SELECT id, min(other) AS "group" FROM r GROUP BY 1""")
def caption_groups(spark, sf):
    """Utterances in groups of near-identical words, at any distance in time."""
    t = tables.read(spark, sf, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("id"), "text")
    return near_text.near_groups(t, PARAMS.caption_similarity)


@register("tumbling_counts", journal_sql(f"""
SELECT strftime(date_trunc('hour', created), {ISO_Z}) AS window_start, kind, count(*) AS n FROM j GROUP BY 1, 2"""))
def tumbling_counts(spark, sf):
    """Event-time windows of an hour, as a stream counts them."""
    return windows.tumbling_counts(tables.journal(spark, sf)).select(iso_z(F.col("window_start")).alias("window_start"), "kind", "n")
