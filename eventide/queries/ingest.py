"""Registered queries over ingest, journalling and retiming (2.A-2.C, 2.J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventide.functions import payload as P
from eventide.functions.times import iso_local, iso_utc_micros, iso_z, parse_ts
from eventide.operators.dedupe import windowed_duplicates
from eventide.params import IngestParams
from eventide.plans import audit, ingest, retime
from eventide.queries import tables
from eventide.queries.sql import EVENTS, ISO_US, ISO_Z, TURNS, events_sql, journal_sql, turns_sql
from eventide.sources import journal as J
from eventide.sources import jsonl
from eventide.sources.segments import with_bounds
from eventide.streaming import ingest as stream

QUERIES: dict = {}
SQL: dict[str, str] = {}
PARAMS = IngestParams(clips_dir="/record", camera_stub="cam_sim")


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


# The compact text of the lines of tables.lines, its parts, and the segment of a line.
LINES = """
ln AS (
  SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+0000' AS ts_text,
    CASE event_type WHEN 'click' THEN 'click' WHEN 'purchase' THEN 'purchase'
         WHEN 'view' THEN 'motion' WHEN 'signup' THEN 'objects' ELSE 'event' END AS kind,
    CASE WHEN event_type = 'error' THEN 'stage2' ELSE camera END AS source,
    CASE WHEN event_type IN ('click', 'purchase') THEN '"type":"' || event_type || '",'
         WHEN event_type = 'view' THEN '"motion_score":null,'
         WHEN event_type = 'signup' THEN '"type":7,"objects":[],' ELSE '' END AS head,
    CASE WHEN event_type <> 'error' THEN '"source":"' || camera || '",' ELSE '' END AS src,
    CASE WHEN user_id % 5 = 0 THEN '"t0_ms":' || user_id || ',"t1_ms":"' || (user_id + 50) || '",' ELSE '' END AS expl,
    user_id % 5 = 0 AS has_explicit,
    CASE WHEN quarter_no % 3 <> 0 THEN '/record/' ||
      strftime(to_timestamp(quarter_no * 900)::TIMESTAMP, '%Y-%m-%d/cam_sim_%H-%M.mkv') END AS seg_path,
    quarter_no * 900000 AS seg_ms,
    us // 1000000 * 1000 AS sec_ms
  FROM ev
),
rw AS (
  SELECT *, '{' || head || '"ts":"' || ts_text || '",' || src || expl || '"id":' || event_id ||
         ',"msg":"a  \\"b\\"\\t: é"}' AS payload,
    CASE WHEN seg_path IS NOT NULL THEN sha1(seg_path || '|' ||
           strftime(make_timestamp(seg_ms * 1000), '%Y-%m-%dT%H:%M:%SZ') || '|' ||
           strftime(make_timestamp((seg_ms + 900000) * 1000), '%Y-%m-%dT%H:%M:%SZ')) ELSE '' END AS clip_id,
    CASE WHEN has_explicit THEN user_id WHEN seg_path IS NOT NULL THEN greatest(0, sec_ms - seg_ms - 2000)
         ELSE greatest(0, sec_ms % 3600000 - 2000) END + CASE WHEN seg_path IS NOT NULL THEN seg_ms ELSE 0 END AS t0_ms,
    CASE WHEN has_explicit THEN user_id + 50 WHEN seg_path IS NOT NULL THEN sec_ms - seg_ms + 3000
         ELSE sec_ms % 3600000 + 3000 END + CASE WHEN seg_path IS NOT NULL THEN seg_ms ELSE 0 END AS t1_ms
  FROM ln
)"""


def lines_sql(select: str) -> str:
    return events_sql(select, LINES)


def _rows(spark, sf):
    parsed = jsonl.parse_lines(tables.lines(spark, sf))
    return ingest.normalise(parsed, PARAMS, with_bounds(tables.segments(spark, sf)))


@register("kind_inference", lines_sql("SELECT event_id AS line_no, kind, source FROM rw"))
def kind_inference(spark, sf):
    v = F.col("obj")
    return jsonl.parse_lines(tables.lines(spark, sf)).select(
        "line_no", P.kind_of(v).alias("kind"), P.source_of(v, "stage2").alias("source"))


@register("event_ids_sha1", lines_sql("""
SELECT event_id AS line_no, payload,
       sha1(source || '|' || kind || '|' || CASE WHEN clip_id = '' THEN '-' ELSE clip_id END || '|' || t0_ms || '|' ||
            left(sha1(payload), 16)) AS event_id FROM rw"""))
def event_ids_sha1(spark, sf):
    return _rows(spark, sf).select("line_no", "payload", "event_id")


@register("offsets", lines_sql("""
SELECT event_id AS line_no, t0_ms, t1_ms, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS created_utc,
       CASE WHEN seg_path IS NOT NULL THEN 'epoch' WHEN has_explicit THEN 'explicit' ELSE 'hour' END AS offset_basis
FROM rw"""))
def offsets(spark, sf):
    return _rows(spark, sf).select(
        "line_no", "t0_ms", "t1_ms", iso_z(F.col("created_utc")).alias("created_utc"), "offset_basis")


@register("explicit_offsets", lines_sql("""
SELECT event_id AS line_no, CASE WHEN has_explicit THEN user_id END AS x0,
       CASE WHEN has_explicit THEN user_id + 50 END AS x1 FROM rw"""))
def explicit_offsets(spark, sf):
    x0, x1 = P.explicit_offsets(F.col("obj"))
    return jsonl.parse_lines(tables.lines(spark, sf)).select("line_no", x0.alias("x0"), x1.alias("x1"))


@register("segment_bounds", lines_sql("""
SELECT DISTINCT seg_path AS path, clip_id, strftime(make_timestamp(seg_ms * 1000), '%Y-%m-%dT%H:%M:%SZ') AS start_utc,
       strftime(make_timestamp((seg_ms + 900000) * 1000), '%Y-%m-%dT%H:%M:%SZ') AS end_utc
FROM rw WHERE seg_path IS NOT NULL"""))
def segment_bounds(spark, sf):
    s = with_bounds(tables.segments(spark, sf))
    return s.select("path", "clip_id", iso_z(F.col("start_utc")).alias("start_utc"), iso_z(F.col("end_utc")).alias("end_utc"))


@register("segment_join", lines_sql("SELECT event_id AS line_no, clip_id FROM rw"))
def segment_join(spark, sf):
    return _rows(spark, sf).select("line_no", "clip_id")


@register("clip_rows", lines_sql("SELECT DISTINCT clip_id, seg_path AS path FROM rw WHERE clip_id <> ''"))
def clip_rows(spark, sf):
    segs = with_bounds(tables.segments(spark, sf))
    return ingest.clip_rows(_rows(spark, sf), segs).select("clip_id", "path")


@register("ingest_plan", lines_sql("""
SELECT '/events/' || strftime(ts, '%Y-%m-%d') || '/' || camera || '.jsonl' AS file, event_id AS line_no, kind, t0_ms,
       left(clip_id, 10) AS clip FROM rw"""))
def ingest_plan(spark, sf):
    return ingest.plan(_rows(spark, sf))


@register("quarantine", lines_sql("""
SELECT event_id AS line_no, left(rtrim('{"' || camera || '": ' || repeat('x', CAST(user_id AS INTEGER) * 3)), 200) AS line
FROM rw WHERE event_type = 'error'"""))
def quarantine(spark, sf):
    """Every error event's line is torn."""
    e = tables.events(spark, sf)
    good = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit("}"))
    torn = F.concat(
        F.lit('{"'), F.col("camera"), F.lit('": '), F.repeat(F.lit("x"), (F.col("user_id") * 3).cast("int")))
    lines = e.select(
        F.lit("/events/a.jsonl").alias("file"), F.col("event_id").alias("line_no"),
        F.when(F.col("event_type") == "error", torn).otherwise(good).alias("line"))
    return jsonl.quarantine(jsonl.parse_lines(lines, once=True)).select("line_no", "line")


@register("ingest_balance", lines_sql("""
SELECT CASE WHEN event_type = 'error' THEN 'not one JSON object' WHEN event_type = 'signup' THEN 'no time' END AS reason,
       count(*) AS lines, count(DISTINCT event_id) AS kept FROM rw GROUP BY 1"""))
def ingest_balance(spark, sf):
    """Every line is journalled or quarantined: errors' lines are torn, sign-ups have no time; each line comes twice."""
    e, c = tables.events(spark, sf), F.col
    body = F.concat(F.lit('{"id": '), c("event_id").cast("string"))
    line = (
        F.when(c("event_type") == "error", F.concat(body, F.lit(', "x"')))
        .when(c("event_type") == "signup", F.concat(body, F.lit("}")))
        .otherwise(F.concat(body, F.lit(', "ts": "'), iso_local(c("ts")), F.lit('"}')))
    )
    once = e.select(F.lit("/events/d/a.jsonl").alias("file"), line.alias("line"))
    rows = ingest.classified(jsonl.parse_lines(once.unionAll(once)), PARAMS, ingest.empty_segments(spark))
    kept = F.when(c("reason").isNull(), c("event_id")).otherwise(F.sha1("line"))
    return rows.groupBy("reason").agg((F.count(F.lit(1)) / 2).cast("bigint").alias("lines"), F.count_distinct(kept).alias("kept"))


@register("peek_keys", lines_sql("""
SELECT event_id AS line_no, kind, CASE event_type WHEN 'view' THEN 'motion_score|' WHEN 'signup' THEN 'type|objects|'
         WHEN 'error' THEN '' ELSE 'type|' END || 'ts' || CASE WHEN event_type <> 'error' THEN '|source' ELSE '' END ||
         CASE WHEN has_explicit THEN '|t0_ms|t1_ms' ELSE '' END || '|id|msg' AS keys FROM rw"""))
def peek_keys(spark, sf):
    return audit.peek(jsonl.parse_lines(tables.lines(spark, sf)), PARAMS).select(
        "line_no", "kind", F.array_join("keys", "|").alias("keys"))


@register("clip_audit", lines_sql("""
SELECT event_id AS line_no, CASE WHEN event_type = 'view' OR seg_path IS NULL THEN 'MISS' ELSE 'OK' END AS tag FROM rw"""))
def clip_audit(spark, sf):
    """Lines name the recording of their quarter hour; views name none."""
    e = tables.events(spark, sf)
    clip = F.date_format(tables.quarter_start(F.col("ts")), "'record\\\\'yyyy-MM-dd'\\\\cam_sim_'HH-mm'.mkv'")
    line = F.concat(
        F.lit('{"clip": "'), F.when(F.col("event_type") == "view", F.lit(" ")).otherwise(clip), F.lit('"}'))
    lines = e.select(F.lit("/events/d/a.jsonl").alias("file"), F.col("event_id").alias("line_no"), line.alias("line"))
    return audit.clip_audit(jsonl.parse_lines(lines), tables.segments(spark, sf), PARAMS).select("line_no", "tag")


@register("window_dedupe", events_sql("""
SELECT event_id, t0 AS t0_ms FROM rp r WHERE NOT EXISTS (
  SELECT 1 FROM kn k WHERE k.clip = r.clip AND k.kind = r.kind AND k.props = r.props
    AND k.t0 BETWEEN greatest(0, r.t0 - 2000) AND r.t0 + 2000)""",
    "kn AS (SELECT event_id, camera AS clip, event_type AS kind, props, us // 1000 AS t0 FROM ev)",
    "rp AS (SELECT event_id, clip, kind, props, t0 + (event_id % 7 - 3) * 1000 AS t0 FROM kn)"))
def window_dedupe(spark, sf):
    """All events replayed with a jitter of up to 3 s; those within 2 s of the original are duplicates."""
    c = F.col
    known = tables.events(spark, sf).select(
        "event_id", c("camera").alias("clip_id"), c("event_type").alias("kind"), c("props").alias("payload"),
        F.unix_millis("ts").alias("t0_ms"))
    replay = known.withColumn("t0_ms", c("t0_ms") + (c("event_id") % 7 - 3) * 1000)
    return windowed_duplicates(replay, known, 2.0, "left_anti").select("event_id", "t0_ms")


@register("insert_or_ignore", journal_sql(
    "SELECT DISTINCT event_id, source, kind FROM j WHERE kind NOT IN ('click', 'speech')"))
def insert_or_ignore(spark, sf):
    """The journal sent twice into one that has the clicks and the speech."""
    j = tables.journal(spark, sf).withColumn(J.DATE, F.to_date("created_utc"))
    existing = j.where(F.col("kind").isin("click", "speech"))
    return J.new_rows(j.unionAll(j), existing, "event_id", J.DATE).select("event_id", "source", "kind")


CAPTION_LINES = f"""
cp AS (SELECT *, CASE WHEN spoken_s IS NOT NULL THEN ts + to_seconds(spoken_s) ELSE ts END AS stop FROM tn)"""


@register("captions", turns_sql(f"""
SELECT conv_id, turn, text, 'en' AS lang, strftime(ts, {ISO_Z}) AS start_utc, strftime(stop, {ISO_Z}) AS end_utc,
       strftime(ts, {ISO_Z}) AS created_utc FROM cp""", CAPTION_LINES))
def captions(spark, sf):
    """Captions of the conversation turns; odd conversations have no utterance end."""
    c = F.col
    obj = F.to_json(F.struct(
        c("kind").alias("type"), iso_z(c("ts")).alias("ts"), "text", F.lit("en").alias("lang"),
        iso_z(c("ts")).alias("start_utc"), iso_z(c("end_ts")).alias("end_utc")))
    lines = tables.turns(spark, sf).select(
        "conv_id", "turn", F.lit("/events/d/audio.jsonl").alias("file"), obj.alias("line"))
    rows = ingest.normalise(jsonl.parse_lines(lines), PARAMS, ingest.empty_segments(spark))
    caps = ingest.caption_rows(rows.withColumn("event_id", F.concat_ws("_", "conv_id", "turn")))
    key = F.split("event_id", "_")
    z = lambda n: iso_z(c(n)).alias(n)
    return caps.select(
        key[0].cast("bigint").alias("conv_id"), key[1].cast("bigint").alias("turn"), "text", "lang",
        z("start_utc"), z("end_utc"), z("created_utc"))


@register("retime", events_sql("""
SELECT event_id AS line_no,
       strftime(date_trunc('second', ts) + (g.target - date_trunc('hour', g.first_ts)), '%Y-%m-%dT%H:%M:%S') || '+0000' AS ts,
       CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+0000' END AS inner_ts
FROM ev JOIN (SELECT camera, arg_min(ts, event_id) AS first_ts,
                     TIMESTAMP '2024-02-01' + to_hours(max(user_id) % 24) AS target FROM ev GROUP BY camera) g
USING (camera)"""))
def retime_query(spark, sf):
    """One shard per camera, each moved to an hour of its own on 1 February."""
    c = F.col
    e = tables.events(spark, sf)
    inner = F.when(c("event_id") % 3 == 0, F.concat(F.lit(', "meta": {"ts": "'), iso_local(c("ts")), F.lit('"}'))).otherwise("")
    line = F.concat(
        F.lit('{"id": '), c("event_id").cast("string"), inner, F.lit(', "ts": "'), iso_local(c("ts")), F.lit('"}'))
    parsed = jsonl.parse_lines(e.select(c("camera").alias("file"), c("event_id").alias("line_no"), line.alias("line")))
    hours = F.make_dt_interval(hours=(F.max("user_id") % 24).cast("int"))
    targets = e.groupBy(c("camera").alias("file")).agg(
        (F.lit("2024-02-01").cast("timestamp") + hours).alias("target"))
    return retime.retime(parsed, targets, ["line_no"]).select(
        "line_no", F.get_json_object("line", "$.ts").alias("ts"), F.get_json_object("line", "$.meta.ts").alias("inner_ts"))


@register("transcript_align", f"""WITH {EVENTS}, {TURNS},
sh AS (SELECT *, (SELECT date_trunc('second', arg_min(ts, event_id)) FROM ev) - (SELECT min(ts) FROM tn) AS d FROM tn)
SELECT conv_id, turn, strftime(ts + d, {ISO_Z}) AS start_utc,
       CASE WHEN spoken_s IS NOT NULL THEN strftime(ts + to_seconds(spoken_s) + d, {ISO_Z}) END AS end_utc,
       strftime(ts + d, '%Y-%m-%dT%H:%M:%S') || '+0000' AS loc_ts,
       strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS inner_utc FROM sh""")
def transcript_align(spark, sf):
    """Turns moved so that the first one falls on the first event."""
    c = F.col
    obj = F.to_json(F.struct(
        "conv_id", "turn", F.struct(iso_z(c("ts")).alias("start_utc")).alias("was"), iso_z(c("ts")).alias("start_utc"),
        iso_z(c("end_ts")).alias("end_utc")))
    parsed = jsonl.parse_lines(tables.turns(spark, sf).select(
        F.lit("t.jsonl").alias("file"), "conv_id", "turn", obj.alias("line")))
    shard = jsonl.parse_lines(tables.lines(spark, sf))
    anchor = retime.first_event_time(shard, ["line_no"])
    out = retime.align_transcript(parsed, anchor, ["conv_id", "turn"])
    get = lambda n: F.get_json_object("line", f"$.{n}").alias(n)
    return out.select("conv_id", "turn", get("start_utc"), get("end_utc"), get("loc_ts"),
                      F.get_json_object("line", "$.was.start_utc").alias("inner_utc"))


@register("iso_formats", events_sql(f"""
SELECT event_id, strftime(ts, {ISO_US}) || '+00:00' AS micros,
       strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S') || '+0530' AS local_text,
       strftime(date_trunc('second', ts), {ISO_Z}) AS parsed FROM ev"""))
def iso_formats(spark, sf):
    """Micro-second and local text of every event time, and the local text read back."""
    ts = F.col("ts")
    local = iso_local(ts, "Asia/Kolkata")
    return tables.events(spark, sf).select(
        "event_id", iso_utc_micros(ts).alias("micros"), local.alias("local_text"), iso_z(parse_ts(local)).alias("parsed"))


@register("offset_fallback", events_sql("""
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN user_id WHEN event_id % 7 = 0 THEN 0 ELSE greatest(0, delta_ms - 2000) END AS t0_ms,
       CASE WHEN event_id % 11 = 0 THEN user_id + 50 WHEN event_id % 7 = 0 THEN 5000 ELSE delta_ms + 3000 END AS t1_ms,
       CASE WHEN event_id % 11 = 0 THEN 'explicit' WHEN event_id % 7 = 0 THEN 'none' ELSE 'hour' END AS basis FROM ev"""))
def offset_fallback(spark, sf):
    """Offsets of events, every seventh without a time, every eleventh with offsets of its own."""
    c = F.col
    ts = F.when(c("event_id") % 7 != 0, c("ts"))
    own = F.when(c("event_id") % 11 == 0, c("user_id").cast("bigint"))
    t0, t1, basis = P.offsets(ts, F.lit(None).cast("timestamp"), own, own + 50, 2000, 3000)
    return tables.events(spark, sf).select("event_id", t0.alias("t0_ms"), t1.alias("t1_ms"), basis.alias("basis"))


@register("late_rows", journal_sql("""
SELECT event_id, kind FROM j WHERE created < (SELECT date_trunc('day', max(created)) FROM j) - INTERVAL 600 SECOND"""))
def late_rows(spark, sf):
    """What a stream that has come to the start of the last day would list as late."""
    j = tables.journal(spark, sf)
    newest = j.agg(F.date_trunc("day", F.max("created_utc"))).first()[0]
    return stream.late_rows(j, newest, 600.0).select("event_id", "kind")
