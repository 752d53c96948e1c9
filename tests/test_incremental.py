"""The rollup that follows the journal, its sketches, and verification by digests."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from eventide.params import IngestParams
from eventide.plans import digests, documents, incremental, ingest, sketches, verify
from eventide.sources import journal as J
from eventide.streaming.ingest import ingest_stream


def shard(root, day, name, rows):
    os.makedirs(f"{root}/events/{day}", exist_ok=True)
    with open(f"{root}/events/{day}/{name}.jsonl", "w") as f:
        for ts, kind, source, more in rows:
            f.write(json.dumps({"type": kind, "ts": ts, "source": source, **more}) + "\n")


def read(spark, root, name):
    if name == "hourly":
        return sorted(r.value for r in spark.read.text(f"{root}/{name}").select("value").collect())
    df = spark.read.parquet(f"{root}/{name}")
    if name == "hour_sketches":
        df = sketches.distincts(df, F.col("hour"))
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


TABLES = ["grain", "tokens", "hour_ids", "hour_digests", "hour_sketches", "hourly", "days"]


def test_stream_with_late_rows_equals_a_full_run(spark, tmp_path):
    root, p = str(tmp_path), IngestParams(clips_dir=f"{tmp_path}/none")
    text = {"text": "Anna saw the dog, the Dog saw Anna", "start_utc": "2025-11-18T06:00:00Z", "end_utc": "2025-11-18T06:00:03Z"}
    shard(root, "2025-11-18", "a", [(f"2025-11-18T{h:02}:10:00Z", "motion.summary", f"cam{h % 3}", {"motion_score": 0.1 * h}) for h in range(5, 9)])
    shard(root, "2025-11-20", "b", [(f"2025-11-20T0{h}:00:00Z", "speech", "mic", text) for h in range(3)])

    def step():
        q = ingest_stream(spark, f"{root}/events", f"{root}/journal", f"{root}/cp", p, availableNow=True)
        q.awaitTermination(300)
        return incremental.refresh(spark, f"{root}/journal", f"{root}/live")

    assert step() == 7 and step() == 0
    stamps = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{root}/live/**/part-*", recursive=True)}
    # a row two days late, a new hour of that day, and a repeated row
    shard(root, "2025-11-18", "late", [("2025-11-18T06:30:00Z", "speech", "mic", text), ("2025-11-18T23:59:59.5Z", "x", "cam9", {}),
                                       ("2025-11-18T05:10:00Z", "motion.summary", "cam2", {"motion_score": 0.5})])
    late_hours = incremental.pending(spark, f"{root}/journal", f"{root}/live").count()
    assert late_hours == 0 and step() == 3
    kept = {f for f in stamps if os.path.exists(f) and os.stat(f).st_mtime_ns == stamps[f]}
    assert {f for f in kept if "/grain/" in f} == {f for f in stamps if "/grain/" in f and not ("date=2025-11-18" in f and ("hh=05" in f or "hh=06" in f))}
    hours = spark.createDataFrame([("2025-11-18 06:00:00",)], "h string").select(F.to_timestamp("h").alias("hour"))
    read_files = incremental.touched_events(spark, f"{root}/journal", hours)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in read_files and "2025-11-18" in read_files
    ingest.ingest(spark, f"{root}/events", f"{root}/batch", p)
    assert incremental.refresh(spark, f"{root}/batch", f"{root}/full") == 8
    for name in TABLES:
        assert read(spark, f"{root}/live", name) == read(spark, f"{root}/full", name), name
    # a document is what the summarise job writes for that hour
    documents.summarize(spark, f"{root}/journal", f"{root}/sum", date="2025-11-18")
    want = {json.loads(r.value)["hour_start_utc"]: json.loads(r.value) for r in spark.read.text(f"{root}/sum/hourly").collect()}
    for line in read(spark, f"{root}/live", "hourly"):
        doc = json.loads(line)
        doc.pop("hour", None)
        if doc["hour_start_utc"].startswith("2025-11-18"):
            assert doc == want[doc["hour_start_utc"]]


def test_verification_reads_only_what_differs(spark, tmp_path):
    root, p = str(tmp_path), IngestParams(clips_dir=f"{tmp_path}/none")
    for day in range(10, 16):
        shard(root, f"2025-11-{day}", "a", [(f"2025-11-{day}T{h:02}:00:{s:02}Z", "x", "c", {"n": s}) for h in range(4) for s in range(5)])
    ingest.ingest(spark, f"{root}/events", f"{root}/journal", p)
    incremental.refresh(spark, f"{root}/journal", f"{root}/out")
    events = J.events(spark, f"{root}/journal")
    asked, known = spark.read.parquet(f"{root}/out/hour_digests"), J.digests(spark, f"{root}/journal")
    ids = spark.read.parquet(f"{root}/out/hour_ids")
    assert digests.differing_hours(asked, known).isEmpty()
    clean = digests.verification(ids, events, asked, known)
    assert clean.first().asDict() == verify.verification(ids.select("event_id"), events).first().asDict()
    scans = clean._jdf.queryExecution().executedPlan().toString()
    assert "events" not in scans and "hour_ids" not in scans  # neither table's ids are read
    # ids of two hours vanish from the journal, and one appears
    lost = (F.col("created_utc") == F.to_timestamp(F.lit("2025-11-12 02:00:03"))) | (F.col("created_utc") == F.to_timestamp(F.lit("2025-11-14 00:00:01")))
    more = events.limit(1).withColumns({"event_id": F.lit("new"), "created_utc": F.to_timestamp(F.lit("2025-11-13 01:00:00"))})
    damaged = events.where(~lost).unionByName(more)
    now = digests.hour_digests(damaged)
    assert sorted(str(r.hour) for r in digests.differing_hours(asked, now).collect()) == ["2025-11-12 02:00:00", "2025-11-13 01:00:00", "2025-11-14 00:00:00"]
    got = digests.verification(ids, damaged, asked, now).first()
    assert got.asDict() == verify.verification(ids.select("event_id"), damaged).first().asDict()
    assert (got.checked_event_ids, got.missing_event_ids) == (120, 2)


@pytest.mark.parametrize("n,bound", [(300, 0), (200_000, 0.03)])
def test_sketches_within_their_bound(spark, n, bound):
    """Small sets are exact; large ones within four standard errors."""
    g = spark.range(n * 2).select(
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 50 * 3600).alias("hour"), F.concat(F.lit("s"), F.col("id") % n).alias("source"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("c"), F.col("id") % (n // 2))).otherwise("").alias("clip_id"))
    got = sketches.distincts(sketches.hour_sketches(g)).first()
    want = g.agg(F.count_distinct("source"), F.count_distinct(F.nullif("clip_id", F.lit("")))).first()
    assert abs(got.unique_sources - want[0]) <= bound * want[0] and abs(got.unique_clips - want[1]) <= bound * want[1]
    exact = {r.hour: r for r in g.groupBy("hour").agg(
        F.count_distinct("source").alias("s"), F.count_distinct(F.nullif("clip_id", F.lit(""))).alias("c")).collect()}
    for r in sketches.distincts(sketches.hour_sketches(g), F.col("hour")).collect():
        e = exact[r.hour]
        assert abs(r.unique_sources - e.s) <= bound * e.s and abs(r.unique_clips - e.c) <= bound * e.c


def test_replayed_shards_stop_before_the_journal(spark, tmp_path):
    """A shard delivered again adds nothing, touches no hour of the journal, and the state holds one hash a line."""
    root, p = str(tmp_path), IngestParams(clips_dir=f"{tmp_path}/none")
    rows = [(f"2025-11-18T{h:02}:10:00Z", "x", "c", {"n": h}) for h in range(20)]
    shard(root, "2025-11-18", "a", rows)

    def step():
        q = ingest_stream(spark, f"{root}/events", f"{root}/journal", f"{root}/cp", p, replays_within="1 hour", availableNow=True)
        q.awaitTermination(300)
        return incremental.pending(spark, f"{root}/journal", f"{root}/out").select("mark").distinct().count(), q.lastProgress

    marks, progress = step()
    held = progress.stateOperators[0].numRowsTotal  # the store counts a key once or twice
    assert J.events(spark, f"{root}/journal").count() == 20 and held in (20, 40)
    shard(root, "2025-11-18", "again", rows)
    with open(f"{root}/events/2025-11-18/again.jsonl", "a") as f:
        f.write("torn {\n" * 3 + '{"type": "new", "ts": "2025-11-10T00:00:00Z"}\n')  # an old time isn't too late
    more, progress = step()
    events = J.events(spark, f"{root}/journal")
    assert events.count() == 21 and events.where("kind = 'new'").count() == 1
    assert [r.copies for r in J.quarantine(spark, f"{root}/journal").collect()] == [3]
    hours = incremental.pending(spark, f"{root}/journal", f"{root}/out").groupBy("mark").agg(F.count("*").alias("n")).collect()
    assert more - marks == 2 and sorted(r.n for r in hours) == [1, 1, 20, 20]
    assert progress.stateOperators[0].numRowsTotal <= held + 2 * 4  # the replayed lines take no room
