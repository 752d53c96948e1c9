"""SQL twins of the adapters in :mod:`eventide.queries.tables` (DuckDB dialect)."""

from __future__ import annotations

from eventide.functions.text import STOPWORDS

WS = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
ISO_Z = "'%Y-%m-%dT%H:%M:%SZ'"
ISO_US = "'%Y-%m-%dT%H:%M:%S.%f'"

STOP_LIST = ", ".join(f"'{w}'" for w in STOPWORDS)

EVENTS = """
ev AS (
  SELECT *, 'cam_' || (user_id % 8) AS camera,
         CAST(CAST(value AS DECIMAL(10,2)) * CAST(0.002 AS DECIMAL(4,3)) AS DECIMAL(12,5)) AS motion_dec,
         CAST(CAST(CAST(value AS DECIMAL(10,2)) * CAST(0.002 AS DECIMAL(4,3)) AS DECIMAL(12,5)) AS DOUBLE) AS motion,
         CAST(epoch_us(ts) AS BIGINT) AS us,
         CAST(floor((epoch_us(ts) - epoch_us(date_trunc('hour', ts))) / 1000) AS BIGINT) AS delta_ms,
         CAST(epoch_us(ts) // 900000000 AS BIGINT) AS quarter_no
  FROM events
)"""

TURNS = f"""
tn AS (
  SELECT conv_id, turn, role, text,
         TIMESTAMP '2024-01-01' + to_seconds(conv_id * 3600 + turn * 60) AS ts,
         CASE WHEN role = 'system' THEN 'speech.suppressed' ELSE 'speech' END AS kind,
         CASE WHEN conv_id % 2 = 0 THEN length(text) % 20 END AS spoken_s,
         'c' || conv_id || '_' || turn AS event_id,
         'mic_' || (conv_id % 4) AS source,
         turn * 60000 AS delta_ms,
         regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') AS clean
  FROM conversations
)"""

JOURNAL = f"""{EVENTS}, {TURNS},
j AS (
  SELECT 'e' || event_id AS event_id, camera AS source,
         CASE WHEN event_type = 'view' THEN 'motion.summary' ELSE event_type END AS kind,
         greatest(0, delta_ms - 2000) AS t0_ms, delta_ms + 3000 AS t1_ms,
         CASE WHEN quarter_no % 3 = 0 THEN '' ELSE camera || '/' || (quarter_no * 900) END AS clip_id,
         CASE WHEN event_type = 'view' THEN motion_dec END AS motion,
         CAST(NULL AS BIGINT) AS speech_ms, CAST(NULL AS VARCHAR) AS text,
         date_trunc('second', ts) AS created, date_trunc('hour', ts) AS hour
  FROM ev
  UNION ALL
  SELECT event_id, source, kind,
         greatest(0, delta_ms % 3600000 - 2000), delta_ms % 3600000 + 3000, '', NULL,
         CASE WHEN spoken_s IS NOT NULL THEN spoken_s * 1000
              WHEN greatest(0, delta_ms % 3600000 - 2000) <> 0
              THEN delta_ms % 3600000 + 3000 - greatest(0, delta_ms % 3600000 - 2000)
              ELSE 0 END,
         CASE WHEN kind = 'speech' THEN clean END, ts, date_trunc('hour', ts)
  FROM tn
),
spine AS (
  SELECT unnest(generate_series(
    date_trunc('day', (SELECT min(created) FROM j)),
    date_trunc('day', (SELECT max(created) FROM j)) + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS hour
),
hourly AS (
  SELECT s.hour, count(j.event_id) AS total_events,
         CAST(coalesce(sum(t1_ms - t0_ms), 0) AS BIGINT) AS sum_duration_ms,
         count(*) FILTER (WHERE kind = 'speech') AS speech_events,
         count(*) FILTER (WHERE kind = 'speech.suppressed') AS speech_suppressed_events,
         coalesce(sum(speech_ms), 0) / 1000.0::DOUBLE AS speech_seconds,
         CAST(coalesce(sum(len(list_filter(regexp_split_to_array(text, '{WS}+'), lambda w: w <> ''))), 0) AS BIGINT) AS speech_words,
         CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS speech_chars,
         count(motion) AS motion_summary_events,
         CAST(coalesce(sum(motion), 0) AS DOUBLE) AS motion_peak_score_sum,
         CAST(coalesce(max(motion), 0) AS DOUBLE) AS motion_peak_score_max,
         count(DISTINCT source) AS unique_sources,
         count(DISTINCT nullif(clip_id, '')) AS unique_clips,
         min(created) AS first_created, max(created) AS last_created
  FROM spine s LEFT JOIN j ON j.hour = s.hour GROUP BY s.hour
),
scored AS (
  SELECT *, CASE WHEN m * 100.0 + speech_seconds <= 0 THEN 'none' WHEN m * 100.0 > speech_seconds * 2 THEN 'motion'
                 WHEN speech_seconds > m * 100.0 * 2 THEN 'speech' ELSE 'mixed' END AS basis,
         m * 100.0 + speech_seconds AS raw_score
  FROM (SELECT *, CASE WHEN motion_summary_events > 0 THEN motion_peak_score_sum / motion_summary_events ELSE 0.0::DOUBLE END AS m
        FROM hourly)
),
tok0 AS (
  SELECT hour, created, event_id,
         list_filter(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}_'']+'), lambda w: w <> '') AS toks
  FROM j WHERE text IS NOT NULL
),
tok AS (
  SELECT * FROM (
    SELECT hour, created, event_id, unnest(toks) AS token, unnest(range(0, len(toks))) AS pos FROM tok0)
  WHERE lower(token) NOT IN ({STOP_LIST})
)"""


def journal_sql(select: str) -> str:
    return f"WITH {JOURNAL} {select}"


def events_sql(select: str, *ctes: str) -> str:
    return f"WITH {', '.join([EVENTS, *ctes])} {select}"


def turns_sql(select: str, *ctes: str) -> str:
    return f"WITH {', '.join([TURNS, *ctes])} {select}"


CLASS = """CASE event_type WHEN 'click' THEN 'person' WHEN 'view' THEN 'dog' WHEN 'purchase' THEN 'cat'
           WHEN 'error' THEN 'bird' WHEN 'signup' THEN 'car' END"""

DETECTIONS = f"""
det AS (
  SELECT camera, us // 600000000 AS frame_idx, us // 600000000 * 600 AS ts_s, event_id AS det_idx, {CLASS} AS cls,
         motion AS conf, (user_id * 7 % 700)::DOUBLE AS x1, (user_id * 11 % 400)::DOUBLE AS y1,
         (user_id * 7 % 700)::DOUBLE + (event_id % 5 * 30 + 240)::DOUBLE AS x2,
         (user_id * 11 % 400)::DOUBLE + (event_id % 5 * 30 + 240)::DOUBLE AS y2
  FROM ev
)"""

FRAMES = f"""
fr AS (
  SELECT camera, ts, us, event_id AS frame_idx, motion, event_type IN ('click', 'purchase') AS presence,
         CASE WHEN event_type IN ('click', 'purchase') THEN [{CLASS}] ELSE []::VARCHAR[] END AS objects,
         CAST(trunc(value * 100) AS BIGINT) AS bytes
  FROM ev
)"""
