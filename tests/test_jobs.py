"""Jobs end to end on small shards: ingest, summarise, retime, perceive, stream."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from eventide.functions import payload as PL
from eventide.functions import times
from eventide.params import IngestParams, PerceptionParams
from eventide.plans import audit, documents, ingest, perceive, retime, rollup
from eventide.sources import journal as J
from eventide.sources import jsonl
from eventide.sources.segments import list_segments, with_bounds
from eventide.streaming.ingest import ingest_stream

DAY = "2025-11-18"
LINES = [
    '{"type": "burst.start", "ts": "2025-11-18T06:03:20-0800", "source": "cam_east", "objects": ["dog"], "motion_score": 0.18}',
    "",
    "# a comment",
    '{"type": "motion.summary", "ts": "2025-11-18T06:03:41-0800", "source": "cam_east", "motion_score": 0.612, "objects": []}',
    '{"type": "motion.summary", "ts": "2025-11-18T14:12:35Z", "source": "cam_east", "motion_score": "0.25", "clip": ""}',
    '{"torn": 1',
    '[{"type": "list"}]',
    '{"type": "a"}{"type": "b"}',
    '{"motion_score": null, "ts": "2025-11-18T15:00:01", "source": null}',
    '{"type": 5, "objects": [], "ts": "2025-11-18T15:10:00+00:00", "t0_ms": 7, "t1_ms": "9"}',
    '{"ts": "2025-11-18T15:20:00.250000+00:00", "start_ms": 1, "end_ms": "x"}',
    '{"type": "nothing", "ts": "not a time"}',
    '{"type": "speech", "ts": "2025-11-18T15:30:00Z", "source": "mic", "start_utc": "2025-11-18T15:30:00Z", '
    '"end_utc": "2025-11-18T15:30:02.500000Z", "text": " Anna\'s café IS open, Bob! Café café ", "lang": "en", "sr": 16000}',
    '{"type": "speech", "loc_ts": "2025-11-18T15:31:00+0000", "source": "mic", "text": "bob I"}',
    '{"type": "speech.suppressed", "ts": "2025-11-18T15:32:00Z", "source": "mic"}',
    '{"type": "burst.start", "ts": "2025-11-18T06:03:20-0800", "source": "cam_east", "objects": ["dog"], "motion_score": 0.18}',
]
GOOD = 10  # journalled lines, one of them twice


@pytest.fixture()
def shard(tmp_path):
    d = tmp_path / "events" / DAY
    d.mkdir(parents=True)
    (d / "a.jsonl").write_text("\n".join(LINES) + "\n", encoding="utf-8")
    return str(tmp_path)


def test_ingest_is_idempotent_and_complete(spark, shard):
    p = IngestParams(clips_dir=f"{shard}/record")
    first = ingest.ingest(spark, f"{shard}/events", f"{shard}/journal", p)
    assert (first.events, first.candidates, first.captions, first.clips) == (GOOD - 1, GOOD, 3, 0)
    assert first.candidates + first.quarantined == sum(bool(x) and not x.startswith("#") for x in LINES)
    bad = J.quarantine(spark, f"{shard}/journal").orderBy("line_no").collect()
    assert [(r.line_no, r.line, r.reason, r.copies) for r in bad] == [
        (i + 1, LINES[i], ingest.NO_TIME if i == 11 else ingest.NOT_JSON, 1) for i in (5, 6, 7, 11)]
    again = ingest.ingest(spark, f"{shard}/events", f"{shard}/journal", p)
    assert (again.events, again.captions, again.clips, again.quarantined) == (0, 0, 0, 4)
    assert J.quarantine(spark, f"{shard}/journal").count() == 4
    assert ingest.dry_run(spark, f"{shard}/events", p).count() == GOOD
    # a shard that grew
    with open(f"{shard}/events/{DAY}/a.jsonl", "a") as f:
        f.write('{"type": "x", "ts": "2025-11-18T16:00:00Z"}\n')
    assert ingest.ingest(spark, f"{shard}/events", f"{shard}/journal", p).events == 1

    rows = {r.payload: r for r in J.events(spark, f"{shard}/journal").collect()}
    for text in LINES:
        try:
            obj = json.loads(text)
        except ValueError:
            continue
        if not isinstance(obj, dict) or obj.get("type") == "nothing":
            continue
        compact = json.dumps(obj, ensure_ascii=False, separators=(",", ":"))
        r = rows[compact]
        short = hashlib.sha1(compact.encode()).hexdigest()[:16]
        basis = f"{r.source}|{r.kind}|-|{r.t0_ms}|{short}"
        assert r.event_id == hashlib.sha1(basis.encode()).hexdigest()
    at = {r.kind + "/" + str(r.created_utc)[11:]: (r.source, r.t0_ms, r.t1_ms, r.offset_basis) for r in rows.values()}
    assert at["burst.start/14:03:20"] == ("cam_east", 198000, 203000, "hour")
    assert at["motion/15:00:01"] == ("stage2", 0, 4000, "hour")
    assert at["objects/15:10:00"] == ("stage2", 7, 9, "explicit")
    assert at["event/15:20:00"] == ("stage2", 1198250, 1203250, "hour")
    # no ts of its own: the time comes from loc_ts, the offsets are the fallback
    assert at["speech/15:31:00"] == ("mic", 0, 5000, "none")


def test_jobs_leave_no_staged_tables(spark, shard):
    from eventide.session import shared_dir

    folder = os.path.join(shared_dir(spark), "stage")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    ingest.ingest(spark, f"{shard}/events", f"{shard}/journal", IngestParams(clips_dir=f"{shard}/record"))
    documents.summarize(spark, f"{shard}/journal", f"{shard}/out")
    assert set(os.listdir(folder)) == before


def test_quarantine_and_numbers(spark, shard):
    scan = jsonl.scan_lines(spark, f"{shard}/events/*/*.jsonl")
    parsed = jsonl.parse_lines(scan)
    bad = jsonl.number_lines(jsonl.quarantine(parsed), scan).orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in bad] == [(i + 1, LINES[i]) for i in (5, 6, 7)]
    lost = jsonl.number_lines(ingest.untimed(parsed), scan).collect()
    assert [r.line_no for r in lost] == [12]
    # the limit counts bad lines, but not blank ones and comments
    few = jsonl.parse_lines(jsonl.first_lines(jsonl.number_lines(scan, scan), 4))
    assert few.orderBy("line_no").select("line_no", F.col("obj").isNull().alias("bad")).collect() == [
        (1, False), (4, False), (5, False), (6, True)]


def test_long_lines_are_built_and_walked_once(spark):
    """A line that is an expression is computed once; its trimming is Python's, and skipped where neither end needs it."""
    made = spark.range(3).select("id", F.concat(F.lit('{"x": '), F.repeat(F.lit("y"), (F.col("id") * 400).cast("int"))).alias("line"))
    bad = jsonl.quarantine(jsonl.parse_lines(made, once=True))
    plan = bad._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("repeat(") == 1 and plan.count("trim(") == 1
    assert {(r.id, r.line) for r in bad.collect()} == {(k, ('{"x": ' + "y" * 400 * k).strip()[:200]) for k in range(3)}
    ends = ["", " ", "\x85", "\u3000x", *times.WS_CHARS]
    texts = [f"{a}{body}{b}" for a in ends for b in ends for body in ("", "a", "#", "é \u2003 é")] + [None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, line string")
    got = {r.id: r.line for r in jsonl.clean_lines(rows, once=True).collect()}
    assert got == {k: t.strip() for k, t in enumerate(texts) if t and t.strip() and not t.strip().startswith("#")}


def test_line_numbers_across_splits(spark, tmp_path):
    for f in "ab":
        (tmp_path / f"{f}.jsonl").write_text("".join(f"{f}{i}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = jsonl.read_lines(spark, f"{tmp_path}/*.jsonl").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 10000
    assert all(r.line == f"{r.file[-7]}{r.line_no - 1}" for r in rows)


def test_summaries(spark, shard):
    ingest.ingest(spark, f"{shard}/events", f"{shard}/journal", IngestParams(clips_dir=f"{shard}/record"))
    window = documents.summarize(spark, f"{shard}/journal", f"{shard}/out")
    assert [str(w)[:19] for w in window] == [f"{DAY} 00:00:00", f"{DAY} 23:59:59"]
    part = [f for f in os.listdir(f"{shard}/out/hourly") if f.endswith(".json")]
    assert len(part) == 1
    hours = [json.loads(line) for line in open(f"{shard}/out/hourly/{part[0]}", encoding="utf-8")]
    assert [h["hour_start_utc"][11:13] for h in hours] == [f"{i:02d}" for i in range(24)]
    assert hours[0]["excitement_basis"] == "none" and hours[0]["event_ids"]["count"] == 0 and hours[0]["top_words"] == []
    h14, h15 = hours[14], hours[15]
    assert (h14["total_events"], h14["motion_summary_events"], h14["motion_peak_score_max"]) == (3, 2, 0.612)
    assert h14["excitement_score"] == 43.1 and h14["excitement_basis"] == "motion"
    assert h14["counts_by_kind"] == {"burst.start": 1, "motion.summary": 2}
    assert h14["event_ids"] == {"count": 3, "table": "hour_ids", "date": DAY, "hh": "14"}
    ids = spark.read.parquet(f"{shard}/out/hour_ids").where("hh = '14'").collect()
    assert len(ids) == 3
    # 2.5 s spoken, 5 s by offsets of the suppressed one; t0 = 0 gives no fallback
    assert h15["speech_seconds"] == 7.5 and h15["speech_events"] == 2 and h15["speech_suppressed_events"] == 1
    assert h15["speech_words"] == 9 and h15["speech_chars"] == len("Anna's café IS open, Bob! Café café") + len("bob I")
    assert h15["top_words"] == [{"word": "café", "count": 3}, {"word": "bob", "count": 2}, {"word": "anna's", "count": 1}]
    assert h15["top_proper_names"] == [{"name": n, "count": 1} for n in ("Anna's", "Bob", "Café")]
    day_dir = f"{shard}/out/daily/date={DAY}"
    day = json.load(open(os.path.join(day_dir, [f for f in os.listdir(day_dir) if f.endswith(".json")][0])))
    assert day["total_events"] == GOOD - 1 and len(day["hours"]) == 24
    assert day["excitement_daily"]["max_hour"]["hour_start_utc"] == f"{DAY}T14:00:00Z"
    assert day["excitement_daily"]["min_hour"]["hour_start_utc"] == f"{DAY}T00:00:00Z"
    assert day["lexical"]["most_common_word"] == "café" and day["lexical"]["most_common_proper_name"] == "Anna's"
    assert day["verification"]["checked_event_ids"] == GOOD - 1 and day["verification"]["missing_event_ids"] == 0


def test_empty_window_reports_the_row_count(spark, shard):
    ingest.ingest(spark, f"{shard}/events", f"{shard}/journal", IngestParams(clips_dir=f"{shard}/record"))
    documents.summarize(spark, f"{shard}/journal", f"{shard}/out")  # ids of another day stay on disk
    ids = lambda: sorted(r.event_id for r in spark.read.parquet(f"{shard}/out/hour_ids").collect())
    whole = ids()
    # a window that ends inside an hour leaves that hour's ids, and those of other hours, as they are
    documents.summarize(spark, f"{shard}/journal", f"{shard}/out", start=f"{DAY}T14:00:00Z", end=f"{DAY}T15:10:00Z")
    assert ids() == whole and len(whole) == GOOD - 1
    documents.summarize(spark, f"{shard}/journal", f"{shard}/out", start="2025-11-19T00:00:00Z", end="2025-11-19T01:30:00Z")
    d = f"{shard}/out/daily/date=2025-11-19"
    day = json.load(open(os.path.join(d, [f for f in os.listdir(d) if f.endswith(".json")][0])))
    assert len(day["hours"]) == 2 and day["total_events"] == 0
    assert day["verification"]["db_count_in_window"] == 0


def test_segments(spark, tmp_path):
    for name in ("cam_14-07.mkv", "cam_14-30.MP4", "cam_14.mkv", "cam_14", "cam_9-x.txt", "cam_25-00.mkv", "other.mkv"):
        d = tmp_path / "record" / DAY
        d.mkdir(parents=True, exist_ok=True)
        (d / name).write_text("x")
    segs = with_bounds(list_segments(spark, f"{tmp_path}/record"))
    got = {r.path.rsplit("/", 1)[1]: (r.start_utc and str(r.start_utc)[11:16], r.end_utc and str(r.end_utc)[11:16]) for r in segs.collect()}
    assert got == {
        "cam_14-07.mkv": ("14:00", "14:15"), "cam_14-30.MP4": ("14:30", "14:45"), "cam_14.mkv": (None, None),
        "cam_14": ("14:00", "15:00"), "cam_9-x.txt": ("09:00", "10:00"), "cam_25-00.mkv": (None, None), "other.mkv": (None, None)}
    path = f"{tmp_path}/record/{DAY}/cam_14-30.MP4"
    want = hashlib.sha1(f"{path}|{DAY}T14:30:00Z|{DAY}T14:45:00Z".encode()).hexdigest()
    assert segs.where(F.col("path") == path).first().clip_id == want


def test_clip_join_and_audit(spark, tmp_path):
    d, e = tmp_path / "record" / DAY, tmp_path / "events" / DAY
    d.mkdir(parents=True)
    e.mkdir(parents=True)
    (d / "cam_sim_14-00.mkv").write_text("x")
    (e / "media").mkdir()
    (e / "media" / "x.mp4").write_text("x")
    (tmp_path / "else").mkdir()
    (tmp_path / "else" / "y.mp4").write_text("y")
    (e / "a.jsonl").write_text("\n".join([
        '{"type": "a", "ts": "%sT14:01:00Z"}' % DAY,
        '{"type": "b", "ts": "%sT14:20:00Z"}' % DAY,
        '{"type": "c", "ts": "%sT14:20:00Z", "clip": "record\\\\%s\\\\cam_sim_14-00.mkv"}' % (DAY, DAY),
        '{"type": "d", "ts": "%sT14:01:00Z", "clip": "media/x.mp4"}' % DAY,
        '{"type": "e", "ts": "%sT14:01:00Z", "clip": "%s/else/y.mp4"}' % (DAY, tmp_path),
        '{"type": "f", "ts": "%sT14:01:00Z", "clip": "media/none.mp4"}' % DAY,
    ]))
    p = IngestParams(clips_dir=f"{tmp_path}/record")
    rep = ingest.ingest(spark, f"{tmp_path}/events", f"{tmp_path}/journal", p)
    assert (rep.events, rep.clips) == (6, 3)
    base = 1763474400000
    got = {r.kind: (r.clip_id != "", r.t0_ms, r.offset_basis) for r in J.events(spark, f"{tmp_path}/journal").collect()}
    assert got == {
        "a": (True, base + 58000, "epoch"), "b": (False, 1198000, "hour"), "c": (True, base + 1198000, "epoch"),
        "d": (True, 58000, "hour"), "e": (True, 58000, "hour"), "f": (False, 58000, "hour")}
    scan = jsonl.scan_lines(spark, f"{tmp_path}/events/*/*.jsonl")
    parsed = jsonl.parse_lines(jsonl.number_lines(scan, scan))
    segs = list_segments(spark, f"{tmp_path}/record")
    tags = audit.clip_audit(parsed, segs, p, sample=20).orderBy("line_no").collect()
    assert [r.tag for r in tags] == ["MISS", "MISS", "OK", "OK", "OK", "MISS"]
    assert tags[3].clip_path == f"{tmp_path}/events/{DAY}/media/x.mp4"
    first = audit.peek(parsed, p, 2).orderBy("line_no").collect()
    assert [r["keys"] for r in first] == [["type", "ts"]] * 2


def test_windowed_dedupe_in_ingest(spark, tmp_path):
    d, e = tmp_path / "record" / DAY, tmp_path / "events" / DAY
    d.mkdir(parents=True)
    e.mkdir(parents=True)
    (d / "cam_sim_14-00.mkv").write_text("x")
    line = '{"type": "a", "ts": "%sT14:01:00Z"}' % DAY
    (e / "a.jsonl").write_text(line)
    args = spark, f"{tmp_path}/events", f"{tmp_path}/journal"
    assert ingest.ingest(*args, IngestParams(clips_dir=f"{tmp_path}/record")).events == 1
    # other offsets make another id; the window still sees the same payload near by
    near = IngestParams(clips_dir=f"{tmp_path}/record", pre_ms=2500, dedupe_seconds=1.0)
    assert ingest.ingest(*args, near).events == 0
    far = IngestParams(clips_dir=f"{tmp_path}/record", pre_ms=4500, dedupe_seconds=1.0)
    assert ingest.ingest(*args, far).events == 1


def test_retime(spark):
    rows = [
        ("a", 1, '{"type": "x", "ts": "2025-11-18T06:10:00-0800", "msg": "at 2025-11-18T06:10:00-0800"}'),
        ("a", 2, '{"ts": "2025-11-18T07:05:00-0800", "start_ts": "2025-11-18T14:10:00.5+00:00", "end_ts": null}'),
        ("b", 1, '{"ts": "2025-11-18T06:10:00Z"}'), ("b", 2, "torn"), ("c", 1, '{"x": 1}'),
    ]
    parsed = jsonl.parse_lines(spark.createDataFrame(rows, "file string, line_no long, line string"))
    targets = retime.companion_targets(spark, {"a": -1, "b": 1, "c": 1}, F.lit("2026-01-02 10:30:00").cast("timestamp"))
    got = {(r.file, r.line_no): (r.line, r.retimed) for r in retime.retime(parsed, targets, ["line_no"], "America/Los_Angeles").collect()}
    assert got["a", 1] == (
        '{"type": "x", "ts": "2026-01-02T01:10:00-0800", "msg": "at 2025-11-18T06:10:00-0800"}', True)
    assert got["a", 2] == ('{"ts": "2026-01-02T02:05:00-0800", "start_ts": "2026-01-02T01:10:00-0800", "end_ts": null}', True)
    assert got["b", 1] == (rows[2][2], False) and got["c", 1] == (rows[4][2], False)
    lenient = retime.retime(parsed, targets, ["line_no"], per_line=True).where("file = 'b'").orderBy("line_no").collect()
    assert [r.line for r in lenient] == ['{"ts": "2026-01-02T11:10:00+0000"}', "torn"]


def test_transcript(spark):
    rows = [("t", 1, '{"text": "hi", "start_utc": "2025-01-01T00:00:10Z", "end_utc": "2025-01-01T00:00:11.500000Z", '
                     '"ts": "bad", "created_utc": "2025-01-01T00:00:00Z"}'),
            ("t", 2, '{"text": "no time"}')]
    parsed = jsonl.parse_lines(spark.createDataFrame(rows, "file string, line_no long, line string"))
    anchor = spark.range(1).select(F.lit("2025-11-18 14:00:00").cast("timestamp").alias("anchor"))
    out = [r.line for r in retime.align_transcript(parsed, anchor, ["line_no"], "America/Los_Angeles").orderBy("line_no").collect()]
    assert json.loads(out[0]) == {
        "text": "hi", "start_utc": "2025-11-18T14:00:00Z", "end_utc": "2025-11-18T14:00:01.500000Z", "ts": "bad",
        "created_utc": "2025-01-01T00:00:00Z", "loc_ts": "2025-11-18T06:00:00-0800"}
    assert out[1] == rows[1][2]
    none = spark.range(1).select(F.lit(None).cast("timestamp").alias("anchor"))
    late = retime.anchor_or_previous_hour(none, F.lit("2025-11-18 14:20:00").cast("timestamp")).first().anchor
    assert str(late) == "2025-11-18 13:00:00"


def test_retiming_leaves_inner_objects_alone(spark):
    rows = [("a", 1, '{"meta": {"ts": "1999-01-01T00:00:00Z", "x": ["ts"]}, "ts": "2025-11-18T06:10:00Z", "msg": "{\\"ts\\": 1}"}')]
    parsed = jsonl.parse_lines(spark.createDataFrame(rows, "file string, line_no long, line string"))
    targets = retime.companion_targets(spark, {"a": 0}, F.lit("2026-01-02 10:30:00").cast("timestamp"))
    got = retime.retime(parsed, targets, ["line_no"]).first().line
    assert got == rows[0][2].replace("2025-11-18T06:10:00Z", "2026-01-02T10:10:00+0000")


def test_top_words_break_ties_by_the_whole_id(spark):
    at = "2025-11-18 14:00:01"
    rows = [(f"abcdefgh{k}", at, f'{{"text": "{w}"}}') for k, w in enumerate(["mid", "zeta", "alpha"])]
    df = spark.createDataFrame(rows, "event_id string, at string, payload string").select(
        "event_id", F.lit("m").alias("source"), F.lit("speech").alias("kind"), F.lit(0).cast("long").alias("t0_ms"),
        F.lit(0).cast("long").alias("t1_ms"), F.lit("").alias("clip_id"), F.col("at").cast("timestamp").alias("created_utc"), "payload")
    top = rollup.top_k(rollup.word_counts(rollup.token_grain(df)), ["hour"], 3).orderBy("rank").collect()
    assert [r.word for r in top] == ["mid", "zeta", "alpha"]


def test_summaries_read_their_dates_only(spark, shard):
    ingest.ingest(spark, f"{shard}/events", f"{shard}/journal", IngestParams(clips_dir=f"{shard}/record"))
    journal = J.events(spark, f"{shard}/journal")
    lo, hi = F.lit(f"{DAY} 00:00:00").cast("timestamp"), F.lit(f"{DAY} 23:59:59").cast("timestamp")
    ids = rollup.hour_event_ids(J.scan_window(journal, lo, hi)).withColumn("date", F.to_date("hour"))
    plan = documents.verification_row(ids, journal, lo, hi)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: []") == 0 and "created_date" in plan


def test_companions(spark, tmp_path):
    mk = lambda rows: jsonl.parse_lines(spark.createDataFrame(rows, "file string, line_no long, line string"))
    before = mk([("b", 1, '{"ts": "2025-01-01T05:10:00Z"}'), ("b", 2, '{"ts": "2025-01-01T05:20:00Z"}')])
    after = mk([("a", 1, '{"ts": "2025-01-01T05:50:00Z"}'), ("a", 2, '{"ts": "2025-01-01T06:05:00Z"}')])
    said = mk([("t", 1, '{"start_utc": "2020-01-01T00:00:00Z", "text": "x"}'), ("t", 2, '{"text": "y"}')])
    out = retime.companions(before, after, said, ["line_no"], F.lit("2026-01-02 10:30:00").cast("timestamp"))
    got = sorted((r.file, str(r.ts)[11:16], r.retimed) for r in out.collect())
    # the last line of the after shard spills into the hour after its target
    assert got == [("a", "11:50", True), ("a", "12:05", True), ("b", "09:10", True), ("b", "09:20", True),
                   ("t", "09:00", True), ("t", "09:10", True)]
    jsonl.write_shards(out, f"{tmp_path}/events")
    hours = {f[:2] for f in os.listdir(f"{tmp_path}/events/2026-01-02") if f.endswith(".jsonl")}
    assert hours == {"09", "11", "12"}
    first = jsonl.write_shards(out, f"{tmp_path}/days", roll="file")
    again = jsonl.write_shards(out, f"{tmp_path}/days", roll="file", mode="overwrite")
    there = [f for f in os.listdir(f"{tmp_path}/days/2026-01-02") if f.endswith(".jsonl")]
    assert len(there) == len(again) and not set(first) & set(again)
    assert spark.read.text(jsonl.shard_paths(f"{tmp_path}/days")).count() == 6


def test_perceive_writes_events_that_ingest_reads(spark, tmp_path):
    t0 = 1763474400
    frames = [("cam", i, 200, 0.9 if i < 5 else 0.0, i) for i in range(60)]
    dets = [("cam", i, 200, 0, "cat", 0.9, 5.0 + 10 * i, 5.0, 105.0 + 10 * i, 105.0) for i in range(6)]
    at = F.timestamp_seconds(F.col("frame_idx") + t0)
    f = spark.createDataFrame(frames, "camera string, frame_idx long, img_w int, motion double, phash long").withColumn("ts", at)
    d = spark.createDataFrame(
        dets, "camera string, frame_idx long, img_w int, det_idx int, cls string, conf double, x1 double, y1 double, "
        "x2 double, y2 double").withColumn("ts", at)
    perceive.perceive(spark, f, d, str(tmp_path), PerceptionParams())
    lines = [json.loads(r.value) for r in spark.read.text(jsonl.shard_paths(f"{tmp_path}/events")).collect()]
    kinds = sorted(e["type"] for e in lines)
    assert kinds == ["burst.end", "burst.start", "motion.summary", "object.summary", "track.enter.center", "track.exit"]
    one = {e["type"]: e for e in lines}
    assert one["track.enter.center"]["msg"] == "cat[tid=1] entered via center side"
    assert one["object.summary"]["duration_s"] == 7.0
    assert one["object.summary"]["msg"].startswith("cat[tid=1] seen near center side (lost_in_center) for 7.0s (2025-11-18T14:00:01+0000 → ")
    assert one["motion.summary"]["novelty"] is None and one["motion.summary"]["frames"] == {}
    # live to second 7 (time to live), padded by 3 + 3
    assert one["burst.end"]["duration_s"] == 13.0
    assert one["burst.end"]["msg"] == (
        "burst ended for cat; duration 13.0s (2025-11-18T14:00:00+00:00 → 2025-11-18T14:00:07+00:00)")
    rep = ingest.ingest(spark, f"{tmp_path}/events", f"{tmp_path}/journal", IngestParams())
    assert rep.events == 6
    assert documents.summarize(spark, f"{tmp_path}/journal", f"{tmp_path}/summaries", date=DAY) is not None
    assert {r.novelty for r in spark.read.parquet(f"{tmp_path}/frame_labels").collect()} <= {"new", "duplicate"}


def test_stream_equals_batch(spark, shard):
    p = IngestParams(clips_dir=f"{shard}/record")
    os.makedirs(f"{shard}/record/{DAY}")
    with open(f"{shard}/record/{DAY}/cam_sim_14-00.mkv", "w") as f:
        f.write("x")
    with open(f"{shard}/events/{DAY}/b.jsonl", "w") as f:
        f.write('{"type": "late", "ts": "2025-11-17T00:00:00Z"}\n' + LINES[0] + "\n")
    os.utime(f"{shard}/events/{DAY}/a.jsonl", (1, 1))
    for _ in range(2):
        q = ingest_stream(
            spark, f"{shard}/events", f"{shard}/stream", f"{shard}/cp", p, files_per_trigger=1, availableNow=True)
        q.awaitTermination(300)
    ingest.ingest(spark, f"{shard}/events", f"{shard}/batch", p)
    # the same shards again, by batch, into the stream's journal
    assert ingest.ingest(spark, f"{shard}/events", f"{shard}/stream", p).events == 0
    lost = [sorted(r.line for r in J.quarantine(spark, f"{shard}/{k}").collect()) for k in ("stream", "batch")]
    assert lost[0] == lost[1] and len(lost[0]) == 4
    cols = ["event_id", "source", "kind", "t0_ms", "t1_ms", "payload", "created_utc"]
    a, b = (sorted(J.events(spark, f"{shard}/{k}").select(cols).collect()) for k in ("stream", "batch"))
    assert a == b and len(a) == GOOD
    late = spark.read.parquet(f"{shard}/stream/late").collect()
    assert sorted(r.kind for r in late) == ["burst.start", "late"]


def test_missing_column_degrades(spark):
    df = spark.createDataFrame([("e", "k", "2025-11-18 14:00:00")], "event_id string, kind string, created_utc string")
    df = df.withColumn("created_utc", F.col("created_utc").cast("timestamp"))
    with pytest.warns(UserWarning, match="source"):
        row = rollup.hourly(rollup.grain(df)).first()
    assert row.total_events == 1 and row.sum_duration_ms == 0 and row.unique_sources == 1


@pytest.mark.parametrize("text,want", [
    ("2025-11-18T06:01:10-0800", "2025-11-18 14:01:10"), ("2025-11-18T06:01:10Z", "2025-11-18 06:01:10"),
    ("2025-11-18T06:01:10.5+00:00", "2025-11-18 06:01:10.500000"), ("2025-11-18 06:01", "2025-11-18 06:01:00"),
    ("2025-11-18", "2025-11-18 00:00:00"), ("T06:01", None), ("2025", None), ("now", None), ("", None),
    ("2025-13-01T00:00:00Z", None), ("2025-11-18T06:01:10 Europe/Paris", None),
])
def test_parse_ts(spark, text, want):
    got = spark.createDataFrame([(text,)], "s string").select(times.parse_ts(F.col("s"))).first()[0]
    assert (got and str(got)) == want


def test_compact_is_byte_equal(spark):
    objs = [{"a": 'q"u\\o', "b": [1, 2.5, None], "é": {"x": "tab\tnl\n"}}, {"long": " \\\" " * 50000}]
    lines = [(json.dumps(o, ensure_ascii=False),) for o in objs]
    got = [r[0] for r in spark.createDataFrame(lines, "s string").select(PL.compact(F.col("s"))).collect()]
    assert got == [json.dumps(o, ensure_ascii=False, separators=(",", ":")) for o in objs]


def test_plain_lines_are_retimed_without_python(spark):
    """Python stands above lines with inner objects alone, which are told apart before anything is parsed."""
    rows = [("a", 1, '{"ts": "2025-11-18T06:00:00Z"}'), ("a", 2, '{"m": {"ts": "2025-11-18T06:00:01Z"}, "ts": "2025-11-18T06:00:01Z"}')]
    parsed = jsonl.parse_lines(spark.createDataFrame(rows, "file string, line_no long, line string"))
    targets = spark.createDataFrame([("a", "2026-01-01 05:30:00")], "file string, t string").select("file", F.to_timestamp("t").alias("target"))
    out = retime.retime(parsed, targets, ["line_no"], per_line=True)
    got = {r.line_no: r.line for r in out.collect()}
    assert got[1] == '{"ts": "2026-01-01T05:00:00+0000"}'
    assert got[2] == '{"m": {"ts": "2025-11-18T06:00:01Z"}, "ts": "2026-01-01T05:00:01+0000"}'
    tree = out._jdf.queryExecution().optimizedPlan().toString()
    below = tree.split("ArrowEvalPython")
    braces = "coalesce((size(regexp_extract_all(trim(line"  # the count of braces, at the scan
    assert len(below) == 2 and f"NOT {braces}" in below[1] and f"AND {braces}" in below[0] and f"NOT {braces}" not in below[0]
