"""Registered queries over frames, detections, tracks and bursts (2.B, 2.C, 2.E, 2.H)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from eventide.functions import geometry as G
from eventide.functions import signals as S
from eventide.functions.times import iso_utc_micros, iso_z
from eventide.operators import asof, blocks, bursts, cooldown, detect, gate, perception_events, tracks, trailing
from eventide.params import PerceptionParams
from eventide.queries import tables
from eventide.queries.sql import CLASS, DETECTIONS, EVENTS, FRAMES, ISO_US, ISO_Z, TURNS, events_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}

DAY = 86400.0
# the driver's events are minutes apart, so every time setting is scaled up
PARAMS = PerceptionParams(
    min_motion_frames=1, merge_grace_s=1200.0, presence_hold_s=900.0, cooldown_s=1800.0, track_ttl_s=1800.0,
    iou_threshold=0.3, buffer_s=3600.0, buffer_bytes=60000, max_detections=2, block_s=DAY,
    min_track_area_px=70000.0, labels=("person", "dog", "cat"),
)
NOVELTY = PerceptionParams(novelty_window_s=30.0, phash_distance_max=24, block_s=300.0)


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def frames_sql(select: str, *ctes: str) -> str:
    return events_sql(select, FRAMES, *ctes)


def detections_sql(select: str, *ctes: str) -> str:
    return events_sql(select, DETECTIONS, *ctes)


def _us(c):
    return iso_utc_micros(F.col(c)).alias(c)


@register("motion_label", events_sql("""
SELECT event_id, CASE WHEN motion < 0.1 THEN 'none' WHEN motion < 0.25 THEN 'minor' WHEN motion < 0.5 THEN 'clear'
       ELSE 'heavy' END AS label, motion >= 0.35 AS over FROM ev"""))
def motion_label(spark, sf):
    m = F.col("motion")
    return tables.events(spark, sf).select(
        "event_id", S.motion_label(m).alias("label"), S.over_gate(m, PARAMS.motion_threshold).alias("over"))


@register("cadence_sample", frames_sql("SELECT camera, frame_idx FROM fr WHERE frame_idx % 3 = 0"))
def cadence_sample(spark, sf):
    """A detector at 10 passes a second on 30 frames a second."""
    return detect.sample_frames(tables.frames(spark, sf), 30.0, PARAMS).select("camera", "frame_idx")


@register("gate_runs", frames_sql("""
SELECT frame_idx, over, CASE WHEN over THEN row_number() OVER (PARTITION BY camera, grp ORDER BY ts, frame_idx)
         - CASE WHEN grp > 0 THEN 1 ELSE 0 END ELSE 0 END AS run
FROM (SELECT *, sum(CASE WHEN over THEN 0 ELSE 1 END) OVER (PARTITION BY camera ORDER BY ts, frame_idx) AS grp
      FROM (SELECT *, motion >= 0.35 AS over FROM fr))"""))
def gate_runs(spark, sf):
    return gate.gate_runs(tables.frames(spark, sf), PARAMS).select("frame_idx", "over", "run")


BURST_CTES = (
    "b1 AS (SELECT *, motion >= 0.35 OR presence AS live FROM fr)",
    """b2 AS (SELECT *, max(CASE WHEN live THEN us END) OVER w AS last_live,
                max(CASE WHEN presence THEN us END) OVER w AS last_pres FROM b1
           WINDOW w AS (PARTITION BY camera ORDER BY us, frame_idx ROWS UNBOUNDED PRECEDING))""",
    """b3 AS (SELECT *, NOT live AND us - last_live >= 1200000000
                AND (last_pres IS NULL OR us - last_pres >= 900000000) AS closes FROM b2)""",
    """b4 AS (SELECT *, lag(closes) OVER w AS was_closed, lag(last_live) OVER w AS live_before FROM b3
           WINDOW w AS (PARTITION BY camera ORDER BY us, frame_idx))""",
    """b5 AS (SELECT *, sum(CASE WHEN live AND (live_before IS NULL OR was_closed) THEN 1 ELSE 0 END)
                OVER (PARTITION BY camera ORDER BY us, frame_idx ROWS UNBOUNDED PRECEDING) AS burst FROM b4)""",
    """bu AS (SELECT camera, burst, min(ts) AS start_ts, max(ts) FILTER (WHERE live) AS last_live_ts, max(ts) AS last_row_ts,
                min(ts) FILTER (WHERE closes) AS close_ts, max(motion) FILTER (WHERE live) AS peak_motion,
                arg_min(motion, (us, frame_idx)) AS first_motion, count(*) FILTER (WHERE live) AS live_frames,
                arg_min(objects, (us, frame_idx)) AS first_objects,
                list_sort(list_distinct(flatten(list(objects) FILTER (WHERE live)))) AS objects,
                (max(us) FILTER (WHERE live) + 3000000 - (min(us) - 3000000)) / 1000000.0::DOUBLE AS duration_s
           FROM b5 WHERE burst > 0 GROUP BY camera, burst)""",
)


def _bursts(spark, sf):
    return bursts.bursts(gate.live_frames(tables.frames(spark, sf), PARAMS), PARAMS)


@register("bursts", frames_sql(f"""
SELECT camera, strftime(start_ts, {ISO_US}) || '+00:00' AS start_ts,
       strftime(last_live_ts, {ISO_US}) || '+00:00' AS last_live_ts, strftime(close_ts, {ISO_US}) || '+00:00' AS close_ts,
       peak_motion, first_motion, live_frames, array_to_string(first_objects, '/') AS first_objects,
       array_to_string(objects, '/') AS objects, round(duration_s, 3) AS duration_s, close_ts IS NULL AS flushed
FROM bu""", *BURST_CTES))
def bursts_query(spark, sf):
    return _bursts(spark, sf).select(
        "camera", _us("start_ts"), _us("last_live_ts"), _us("close_ts"), "peak_motion", "first_motion", "live_frames",
        F.array_join("first_objects", "/").alias("first_objects"), F.array_join("objects", "/").alias("objects"),
        F.round("duration_s", 3).alias("duration_s"), "flushed")


@register("burst_events", frames_sql(f"""
SELECT camera, type, strftime(ts, {ISO_US}) || '+00:00' AS ts, objs AS objects, begin AS start_text FROM (
  SELECT camera, 'burst.start' AS type, start_ts AS ts, array_to_string(first_objects, '/') AS objs, NULL AS begin FROM bu
  UNION ALL SELECT camera, t, coalesce(close_ts, last_row_ts), array_to_string(objects, '/'),
    CASE WHEN t = 'burst.end' THEN strftime(start_ts, {ISO_US}) || '+00:00' END
  FROM bu, (VALUES ('motion.summary'), ('burst.end')) v(t) WHERE duration_s >= 1)""", *BURST_CTES))
def burst_events(spark, sf):
    ev = perception_events.burst_events(_bursts(spark, sf), PARAMS)
    obj = F.from_json("line", "objects array<string>, start_ts string")
    return ev.withColumn("_o", obj).select(
        "camera", "type", _us("ts"), F.array_join("_o.objects", "/").alias("objects"), F.col("_o.start_ts").alias("start_text"))


_BEGIN = f"strftime(start_ts, {ISO_US}) || '+00:00'"
_AT = "coalesce(close_ts, last_row_ts)"


@register("burst_lines", frames_sql(f"""
SELECT camera, type, strftime(seen_at, '%Y-%m-%dT%H:%M:%S') || '+0000' AS ts, source, objects, motion_score, event_id, start_ts, end_ts,
       duration_s FROM (
  SELECT camera, 'burst.start' AS type, start_ts AS seen_at, 'cam_sim' AS source, array_to_string(first_objects, '/') AS objects,
         round(first_motion, 3) AS motion_score, NULL AS event_id, NULL AS start_ts, NULL AS end_ts, NULL::DOUBLE AS duration_s FROM bu
  UNION ALL SELECT camera, 'motion.summary', {_AT}, 'cam_sim', array_to_string(objects, '/'), round(peak_motion, 3),
         'ev_' || sha1(camera || '|' || {_BEGIN}), NULL, NULL, NULL FROM bu WHERE duration_s >= 1
  UNION ALL SELECT camera, 'burst.end', {_AT}, 'cam_sim', array_to_string(objects, '/'), NULL, NULL, {_BEGIN},
         strftime(last_live_ts, {ISO_US}) || '+00:00', round(duration_s, 3) FROM bu WHERE duration_s >= 1)""", *BURST_CTES))
def burst_lines(spark, sf):
    """The fields of the JSON lines; free text aside, whose number formats differ between engines."""
    lines = perception_events.burst_events(_bursts(spark, sf), PARAMS)
    fields = "ts string, source string, objects array<string>, motion_score double, event_id string, start_ts string, end_ts string, duration_s double"
    out = lines.select("camera", "type", F.from_json("line", fields).alias("o")).select("camera", "type", "o.*")
    return out.withColumn("objects", F.array_join("objects", "/"))


_NUMBERS = "[0-9]+([.][0-9]+)?"  # their formats differ between engines


@register("burst_texts", frames_sql(f"""
SELECT camera, type, strftime(seen_at, {ISO_US}) || '+00:00' AS ts, regexp_replace(msg, '{_NUMBERS}', '#', 'g') AS msg FROM (
  SELECT camera, 'burst.start' AS type, start_ts AS seen_at, 'burst started when ' || coalesce(nullif(array_to_string(first_objects, '/'), ''), '-')
         || ' seen; motion_score=0.00' AS msg FROM bu
  UNION ALL SELECT camera, 'motion.summary', {_AT}, label || ' from ' || {_BEGIN} || ' to ' || fin || ' (~0.0s), peak motion_score=0.00'
         || CASE WHEN close_ts IS NULL THEN ' (flush)' ELSE '' END FROM lb
  UNION ALL SELECT camera, 'burst.end', {_AT}, 'burst ended for ' || label || CASE WHEN close_ts IS NULL THEN ' on flush' ELSE '' END
         || '; duration 0.0s (' || {_BEGIN} || ' → ' || fin || ')' FROM lb)""", *BURST_CTES, f"""
lb AS (SELECT *, coalesce(nullif(array_to_string(objects, '/'), ''), 'motion') AS label,
         strftime(last_live_ts, {ISO_US}) || '+00:00' AS fin FROM bu WHERE duration_s >= 1)"""))
def burst_texts(spark, sf):
    """The free text of the lines, numbers masked."""
    lines = perception_events.burst_events(_bursts(spark, sf), PARAMS)
    return lines.select("camera", "type", _us("ts"), F.regexp_replace(F.get_json_object("line", "$.msg"), _NUMBERS, "#").alias("msg"))


@register("sensitive_gate", events_sql("SELECT event_id, motion >= 0.08 AS over, 0.35 AS usual, 10.0 AS cadence_fps FROM ev"))
def sensitive_gate(spark, sf):
    """The gate in the sensitive profile, whose threshold is the lower one."""
    p = PerceptionParams().sensitive()
    return tables.events(spark, sf).select(
        "event_id", S.over_gate(F.col("motion"), p.motion_threshold).alias("over"),
        F.lit(PerceptionParams().motion_threshold).cast("decimal(3,2)").alias("usual"), F.lit(p.cadence_fps).cast("decimal(3,1)").alias("cadence_fps"))


NOVELTY_SQL = """
h AS (SELECT vec_id, 'cam_' || (label % 3) AS camera, list_transform(embedding, lambda x: x > 0) AS bits FROM embeddings),
d AS (SELECT a.vec_id, min(len(list_filter(list_zip(a.bits, b.bits), lambda p: p[1] <> p[2]))) AS dist
      FROM h a LEFT JOIN h b ON a.camera = b.camera AND b.vec_id < a.vec_id AND b.vec_id >= a.vec_id - 30
      WHERE b.vec_id IS NOT NULL GROUP BY a.vec_id)"""


@register("novelty", f"""
WITH {NOVELTY_SQL}
SELECT h.vec_id AS frame_idx, CAST(d.dist AS INTEGER) AS hash_distance,
       CASE WHEN d.dist <= 24 THEN 'duplicate' ELSE 'new' END AS novelty FROM h LEFT JOIN d USING (vec_id)""")
def novelty(spark, sf):
    return trailing.novelty(tables.hashed_frames(spark, sf), NOVELTY).select("frame_idx", "hash_distance", "novelty")


@register("trailing_buffer", frames_sql("""
SELECT r.frame_idx, count(j.frame_idx) AS held_frames, CAST(coalesce(sum(j.bytes), 0) AS BIGINT) AS held_bytes
FROM c r LEFT JOIN c j ON j.camera = r.camera AND j.us >= r.us - 3600000000 AND (j.us, j.frame_idx) <= (r.us, r.frame_idx)
  AND r.cum - (j.cum - j.bytes) <= 60000
GROUP BY r.frame_idx""",
    """c AS (SELECT *, sum(bytes) OVER (PARTITION BY camera ORDER BY us, frame_idx ROWS UNBOUNDED PRECEDING) AS cum FROM fr)"""))
def trailing_buffer(spark, sf):
    out = trailing.buffer_state(tables.frames(spark, sf), PARAMS)
    return out.select("frame_idx", F.col("held_frames").cast("bigint").alias("held_frames"), "held_bytes")


def _targets(spark, sf):
    c = F.col
    return tables.turns(spark, sf).select(
        "conv_id", "turn", F.concat(F.lit("cam_"), (c("conv_id") % 8).cast("string")).alias("camera"), c("ts").alias("at"))


_TG = "tg AS (SELECT conv_id, turn, 'cam_' || (conv_id % 8) AS camera, ts AS at FROM tn)"


@register("nearest_frame", f"""WITH {EVENTS}, {TURNS}, {FRAMES}, {_TG},
p AS (SELECT tg.*, f.ts AS pts, f.frame_idx AS pid FROM tg ASOF LEFT JOIN fr f ON f.camera = tg.camera AND tg.at >= f.ts),
n AS (SELECT tg.*, f.ts AS nts, f.frame_idx AS nid FROM tg ASOF LEFT JOIN fr f ON f.camera = tg.camera AND tg.at < f.ts)
SELECT p.conv_id, p.turn,
       CASE WHEN nts IS NULL OR (pts IS NOT NULL AND p.at - pts <= nts - p.at) THEN pid ELSE nid END AS frame_idx
FROM p JOIN n ON p.conv_id = n.conv_id AND p.turn = n.turn""")
def nearest_frame(spark, sf):
    return asof.nearest_frame(_targets(spark, sf), tables.frames(spark, sf), "at", DAY).select(
        "conv_id", "turn", "frame_idx")


@register("next_frame_after", f"""WITH {EVENTS}, {TURNS}, {FRAMES}, {_TG}
SELECT conv_id, turn, strftime(f.ts, {ISO_US}) || '+00:00' AS next_ts
FROM tg ASOF LEFT JOIN fr f ON f.camera = tg.camera AND tg.at < f.ts""")
def next_frame_after(spark, sf):
    out = asof.next_frame_after(_targets(spark, sf), tables.frames(spark, sf), "at", "next_ts", DAY)
    return out.select("conv_id", "turn", _us("next_ts"))


@register("topk_detections", detections_sql("""
SELECT camera, frame_idx, det_idx, cls FROM (
  SELECT *, row_number() OVER (PARTITION BY camera, frame_idx ORDER BY conf DESC, det_idx) AS r FROM det WHERE conf >= 0.2)
WHERE r <= 2 AND cls IN ('person', 'dog', 'cat')"""))
def topk_detections(spark, sf):
    d = detect.filter_detections(tables.detections(spark, sf), PARAMS)
    return d.select("camera", "frame_idx", F.col("det_idx").cast("bigint").alias("det_idx"), "cls")


@register("frame_objects", detections_sql(
    "SELECT camera, frame_idx, array_to_string(list_sort(list(DISTINCT cls)), '/') AS objects FROM det GROUP BY 1, 2"))
def frame_objects(spark, sf):
    d = detect.frame_objects(tables.detections(spark, sf))
    return d.select("camera", "frame_idx", F.array_join("objects", "/").alias("objects"))


_SIDE = "CASE WHEN (x1 + x2) * 0.5 < 150 THEN 'left' WHEN (x1 + x2) * 0.5 > 850 THEN 'right' ELSE 'center' END"


@register("bbox_side", detections_sql(f"""
SELECT det_idx, {_SIDE} AS side, greatest(0, x2 - x1) * greatest(0, y2 - y1) AS area FROM det"""))
def bbox_side(spark, sf):
    c = F.col
    return tables.detections(spark, sf).select(
        c("det_idx").cast("bigint").alias("det_idx"),
        G.side(G.center_x(c("x1"), c("x2")), c("img_w"), PARAMS.side_margin_frac).alias("side"),
        G.area(c("x1"), c("y1"), c("x2"), c("y2")).alias("area"))


@register("iou_pairs", detections_sql("""
SELECT det_idx, round(o / ((x2 - x1) * (y2 - y1) + (b[3] - b[1]) * (b[4] - b[2]) - o + 1e-6), 6) AS iou FROM (
  SELECT *, greatest(0, least(x2, b[3]) - greatest(x1, b[1])) * greatest(0, least(y2, b[4]) - greatest(y1, b[2])) AS o
  FROM (SELECT *, lag([x1, y1, x2, y2]) OVER (PARTITION BY camera, cls ORDER BY ts_s, det_idx) AS b FROM det))"""))
def iou_pairs(spark, sf):
    """Overlap of every detection with the one before it, per camera and class."""
    d = tables.detections(spark, sf).withColumn("box", F.array("x1", "y1", "x2", "y2"))
    d = blocks.previous(d, ["camera", "cls"], ["ts", "det_idx"], {"prev": "box"}, DAY)
    box = lambda c: tuple(F.col(c)[i] for i in range(4))
    return d.select(F.col("det_idx").cast("bigint").alias("det_idx"), F.round(G.iou(box("box"), box("prev")), 6).alias("iou"))


@register("exit_reason", detections_sql(f"""
SELECT camera, cls, strftime(day, '%Y-%m-%d') AS day, CASE WHEN l IN ('left', 'right') THEN l ELSE 'center' END AS exit_side,
       CASE WHEN l = 'center' THEN 'lost_in_center' WHEN f <> l THEN 'trajectory_side_crossing' ELSE 'edge_exit' END AS exit_reason
FROM (SELECT camera, cls, date_trunc('day', to_timestamp(ts_s)::TIMESTAMP) AS day, arg_min({_SIDE}, (ts_s, det_idx)) AS f,
             arg_max({_SIDE}, (ts_s, det_idx)) AS l FROM det GROUP BY 1, 2, 3)"""))
def exit_reason(spark, sf):
    """First and last side of a class per camera and day."""
    c = F.col
    d = tables.detections(spark, sf).withColumn(
        "side", G.side(G.center_x(c("x1"), c("x2")), c("img_w"), PARAMS.side_margin_frac))
    at = F.struct("ts", "det_idx")
    g = d.groupBy("camera", "cls", F.to_date("ts").alias("day")).agg(
        F.min_by("side", at).alias("f"), F.max_by("side", at).alias("l"))
    return g.select(
        "camera", "cls", F.date_format("day", "yyyy-MM-dd").alias("day"),
        G.exit_side(c("f"), c("l")).alias("exit_side"), G.exit_reason(c("f"), c("l")).alias("exit_reason"))


@register("presence", detections_sql("""
SELECT fr.camera, fr.frame_idx, EXISTS (SELECT 1 FROM sp WHERE sp.camera = fr.camera
         AND fr.frame_idx BETWEEN sp.a AND sp.z + 3) AS covered
FROM (SELECT DISTINCT camera, frame_idx FROM det) fr""",
    """sp AS (SELECT camera, user_id, min(us // 600000000) AS a, min(us // 600000000) + max(event_id % 5) AS z
             FROM ev GROUP BY camera, user_id, us // 86400000000)"""))
def presence(spark, sf):
    """Frames covered by spans: per user and day, from the first slot, as many slots on as the ids say."""
    e = tables.events(spark, sf)
    slot = F.floor(F.unix_seconds("ts") / 600)
    spans = e.groupBy("camera", "user_id", F.to_date("ts").alias("day")).agg(
        F.min(slot).alias("a"), (F.min(slot) + F.max(F.col("event_id") % 5)).alias("z"))
    spans = spans.select(
        "camera", F.timestamp_seconds(F.col("a") * 600).alias("begin"),
        F.timestamp_seconds(F.col("z") * 600 + 1800).alias("until"))
    return asof.covered(tables.detection_frames(spark, sf), spans, "begin", "until", "covered", DAY).select(
        "camera", "frame_idx", "covered")


TRACK = replace(PARAMS, max_detections=100_000, conf_threshold=0.0)


def _tracks(spark, sf):
    d = detect.filter_detections(tables.lane_detections(spark, sf), TRACK)
    return tracks.tracks(d, tables.detection_frames(spark, sf), TRACK)


def _z(seconds):
    return f"strftime(to_timestamp({seconds})::TIMESTAMP, {ISO_Z})"


def _local(seconds):
    return f"(strftime(to_timestamp({seconds})::TIMESTAMP, '%Y-%m-%dT%H:%M:%S') || '+0000')"


LANES_SQL = f"""
ld AS (SELECT camera, us // 600000000 AS slot, {CLASS} AS cls, user_id % {tables.LANES} AS lane, min(event_id) AS det_idx
       FROM ev WHERE {CLASS} IN ('person', 'dog', 'cat') GROUP BY 1, 2, 3, 4),
lg AS (SELECT *, CASE WHEN (slot - lag(slot) OVER (PARTITION BY camera, cls, lane ORDER BY slot)) * 600 <= 1800
                      THEN 0 ELSE 1 END AS brk FROM ld),
li AS (SELECT *, sum(brk) OVER (PARTITION BY camera, cls, lane ORDER BY slot) AS g FROM lg),
lk AS (SELECT *, row_number() OVER (PARTITION BY camera, cls, lane, g ORDER BY slot) AS k FROM li),
lt AS (SELECT camera, cls, lane, min(slot) * 600 AS first_s, max(slot) * 600 AS last_s, count(*) AS matches,
              max(CASE WHEN k = 2 THEN slot * 600 END) AS enter_s, arg_min(det_idx, slot) AS birth,
              CASE WHEN lane * {tables.LANE_PX} + 150 <= 0.15 * {tables.LANES * tables.LANE_PX} THEN 'left'
                   WHEN lane * {tables.LANE_PX} + 150 >= 0.85 * {tables.LANES * tables.LANE_PX} THEN 'right' ELSE 'center' END AS side
       FROM lk GROUP BY camera, cls, lane, g),
fs AS (SELECT DISTINCT camera, us // 600000000 * 600 AS s FROM ev),
lx AS (SELECT lt.*, fs.s AS exit_s FROM lt ASOF LEFT JOIN fs ON lt.camera = fs.camera AND lt.last_s + 1800 < fs.s),
tk AS (SELECT *, row_number() OVER (PARTITION BY camera ORDER BY first_s, birth, cls) AS tid,
              CASE WHEN side = 'center' THEN 'lost_in_center' ELSE 'edge_exit' END AS reason,
              (exit_s - enter_s)::DOUBLE AS dur FROM lx),
tw AS (SELECT *, cls || '[tid=' || tid || ']' AS who FROM tk)"""


def lanes_sql(select: str) -> str:
    return events_sql(select, LANES_SQL)


@register("tracks", lanes_sql(f"""
SELECT camera, tid, cls, {_z('first_s')} AS first_ts, {_z('last_s')} AS last_ts, matches, side AS first_side, side AS last_side,
       {_z('enter_s')} AS enter_ts, {_z('exit_s')} AS exit_ts, dur AS duration_s FROM tw"""))
def tracks_query(spark, sf):
    """Tracks of detections in lanes: births, matches, the second match, sides, exits, numbers."""
    z = lambda n: iso_z(F.col(n)).alias(n)
    return _tracks(spark, sf).select(
        "camera", F.col("tid").cast("bigint").alias("tid"), "cls", z("first_ts"), z("last_ts"), "matches", "first_side",
        "last_side", z("enter_ts"), z("exit_ts"), "duration_s")


@register("tracks_crowd")
def tracks_crowd(spark, sf):
    """Tracks of boxes that overlap in many ways, where greedy matching has to choose; tested against a plain restatement."""
    d = detect.filter_detections(tables.detections(spark, sf), replace(PARAMS, max_detections=20, conf_threshold=0.0))
    return tracks.tracks(d, tables.detection_frames(spark, sf), PARAMS).select(
        "camera", "tid", "cls", iso_z(F.col("first_ts")).alias("first_ts"), iso_z(F.col("last_ts")).alias("last_ts"),
        "matches", "first_side", "last_side", iso_z(F.col("exit_ts")).alias("exit_ts"))


def _track_lines(spark, sf, type_prefix, schema):
    ev = perception_events.track_events(_tracks(spark, sf), TRACK)
    ev = ev.where(F.col("type").startswith(type_prefix)).withColumn("o", F.from_json("line", schema))
    return ev.select("camera", iso_z(F.col("ts")).alias("at"), "o.*")


@register("track_enter", lanes_sql(f"""
SELECT camera, {_z('enter_s')} AS at, 'track.enter.' || side AS type, {_local('enter_s')} AS ts, tid, cls, 0.5 AS confidence,
       who || ' entered via ' || side || ' side' AS msg FROM tw WHERE enter_s IS NOT NULL"""))
def track_enter(spark, sf):
    return _track_lines(
        spark, sf, "track.enter", "type string, ts string, tid bigint, cls string, confidence double, msg string")


@register("track_exit", lanes_sql(f"""
SELECT camera, {_z('exit_s')} AS at, 'track.exit' AS type, {_local('exit_s')} AS ts, tid, cls, side AS last_side,
       side AS exit_side, reason AS exit_reason,
       CASE WHEN side = 'center'
            THEN who || ' lost near center; exit_side=center, exit_reason=lost_in_center (not literally, the detector lost it)'
            ELSE who || ' exited toward ' || side || ' side (exit_reason=edge_exit)' END AS msg
FROM tw WHERE exit_s IS NOT NULL"""))
def track_exit(spark, sf):
    return _track_lines(
        spark, sf, "track.exit", "type string, ts string, tid bigint, cls string, last_side string, exit_side string, "
        "exit_reason string, msg string")


@register("object_summary", lanes_sql(f"""
SELECT camera, {_z('exit_s')} AS at, 'object.summary' AS type, {_local('enter_s')} AS start_ts, {_local('exit_s')} AS end_ts,
       tid, cls, dur AS duration_s, side AS first_side, reason AS exit_reason,
       who || ' seen near ' || side || CASE WHEN side = 'center' THEN ' side (lost_in_center)' ELSE ' side' END || ' for ' ||
         printf('%.1f', dur) || 's (' || {_local('enter_s')} || ' → ' || {_local('exit_s')} || ')' ||
         CASE WHEN side = 'center' THEN ' – track lost near center; not always exited' ELSE '' END AS msg
FROM tw WHERE exit_s IS NOT NULL AND enter_s IS NOT NULL"""))
def object_summary(spark, sf):
    return _track_lines(
        spark, sf, "object.summary", "type string, start_ts string, end_ts string, tid bigint, cls string, duration_s double, "
        "first_side string, exit_reason string, msg string")


@register("cooldown", f"""WITH RECURSIVE {EVENTS},
o AS (SELECT camera, event_type, us, event_id FROM ev),
nx AS MATERIALIZED (SELECT a.camera, a.event_type, a.us, a.event_id, b.us AS nus FROM o a
       ASOF LEFT JOIN (SELECT DISTINCT camera, event_type, us FROM o) b
       ON a.camera = b.camera AND a.event_type = b.event_type AND a.us + 1800000000 <= b.us),
ac AS (
  SELECT camera, event_type, min(us) AS us FROM o GROUP BY 1, 2
  UNION ALL
  SELECT nx.camera, nx.event_type, nx.nus FROM ac JOIN nx USING (camera, event_type, us) WHERE nx.nus IS NOT NULL)
SELECT o.event_id, ac.us IS NOT NULL AS accepted FROM o LEFT JOIN ac USING (camera, event_type, us)""")
def cooldown_query(spark, sf):
    """At most one event per camera and type in 30 minutes, counted from the last accepted."""
    e = tables.events(spark, sf).select("camera", "event_type", "ts", "event_id")
    return cooldown.cooldown(e, ["camera", "event_type"], PARAMS.cooldown_s, DAY, order=["event_id"]).select(
        "event_id", "accepted")
