"""A journal laid out by id: the same rows, and joins that leave the journal where it is."""

import random
import re

import pytest
from pyspark.sql import functions as F

from eventide import schema
from eventide.params import IngestParams
from eventide.plans import ingest
from eventide.sources import by_id
from eventide.sources import journal as J


def batch(spark, rows):
    """Event rows from (id, kind, day); columns that don't matter are null."""
    df = spark.createDataFrame(rows, "event_id string, kind string, day int")
    df = df.withColumn("created_utc", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("day") * 86_400))
    have = {"event_id", "kind", "created_utc"}
    cols = [F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.EVENTS.fields]
    return df.select(*cols).withColumn(J.DATE, F.to_date("created_utc"))


def written(spark, root):
    return sorted((r.event_id, str(r[J.DATE])) for r in J.events(spark, root).collect())


def test_equals_the_plain_layout(spark, tmp_path):
    """Batches that repeat ids of their own and of earlier ones, with a third of the rows on one day."""
    r = random.Random(5)
    plain, laid = str(tmp_path / "plain"), str(tmp_path / "laid")
    by_id.lay_out(spark, laid, 5)
    for _ in range(4):
        ids = [r.randrange(120) for _ in range(90)]
        b = batch(spark, [(f"id{i}", "motion", 0 if i % 3 == 0 else i % 7) for i in ids])
        n = J.append_new(b, J.events(spark, plain), f"{plain}/events", "event_id", J.DATE)
        assert by_id.append_new(b, f"{laid}/events", schema.EVENTS, "event_id", J.DATE, 5) == n
        assert by_id.append_new(b, f"{laid}/events", schema.EVENTS, "event_id", J.DATE, 5) == 0
    assert written(spark, laid) == written(spark, plain)
    empty = b.where("false")
    assert by_id.append_new(empty, f"{laid}/events", schema.EVENTS, "event_id", J.DATE, 5) == 0


def test_many_dates_are_read_as_a_range(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(by_id, "NAMED_DATES", 2)
    root = str(tmp_path)
    b = batch(spark, [(f"id{i}", "motion", i) for i in range(6)])
    by_id.lay_out(spark, root, 3)
    add = lambda: by_id.append_new(b, f"{root}/events", schema.EVENTS, "event_id", J.DATE, 3)
    assert (add(), add()) == (6, 0)


def test_the_journal_is_not_shuffled(spark, tmp_path):
    """All exchanges of the join are the batch's: none lies above the journal's scan, which reads buckets of the batch's date."""
    root = str(tmp_path)
    rows = batch(spark, [(f"id{i}", "motion", i % 4) for i in range(400)])
    by_id.append_new(rows, f"{root}/events", schema.EVENTS, "event_id", J.DATE, 6)
    name = by_id.table(spark, f"{root}/events", schema.EVENTS, "event_id", J.DATE, 6)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = by_id.new_rows(rows.where(F.col("event_id") < "id2").where(F.day(J.DATE) == 15), spark.table(name), "event_id", J.DATE, 6)
        plan = fresh._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    lines = plan.splitlines()
    depth = lambda line: re.search(r"[A-Za-z*]", line).start()
    at = next(i for i, x in enumerate(lines) if "FileScan parquet" in x and name in x)
    assert "SelectedBucketsCount: 6 out of 6" in lines[at] and "PartitionFilters: [" in lines[at]
    above, level = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if line.strip() and depth(line) < level:
            above.append(line)
            level = depth(line)
    assert any("Join" in x for x in above) and not any("Exchange" in x for x in above)
    assert plan.count("Exchange hashpartitioning") == 1


def test_layout_is_for_new_journals(spark, tmp_path):
    root = str(tmp_path)
    assert by_id.buckets_of(spark, root) is None
    by_id.lay_out(spark, root, 4)
    by_id.lay_out(spark, root, 4)
    assert by_id.buckets_of(spark, root) == 4
    for wrong in (8, 0):
        with pytest.raises(ValueError):
            by_id.lay_out(spark, root, wrong)
    plain = str(tmp_path / "plain")
    J.append_new(batch(spark, [("a", "motion", 1)]), J.events(spark, plain), f"{plain}/events", "event_id", J.DATE)
    with pytest.raises(ValueError):
        by_id.lay_out(spark, plain, 4)


def test_ingest_into_a_journal_by_id(spark, tmp_path):
    """Ingest, growing shards and a second run add what they add to a plain journal; rows meet in buckets of their ids."""
    shards = tmp_path / "events" / "2025-01-01"
    shards.mkdir(parents=True)
    line = '{{"type":"motion","ts":"2025-01-01T10:{:02d}:00Z","score":0.5}}\n'
    reports = {}
    for name, p in (("plain", IngestParams(clips_dir="/none")), ("laid", IngestParams(clips_dir="/none", id_buckets=4))):
        root, got = str(tmp_path / name), []
        for n in (20, 20, 35):
            (shards / "a.jsonl").write_text("".join(line.format(m) for m in range(n)))
            got.append(ingest.ingest(spark, str(tmp_path / "events"), root, p))
        reports[name] = [(r.events, r.skipped) for r in got]
    assert reports["laid"] == reports["plain"] == [(20, 0), (0, 20), (15, 20)]
    assert written(spark, str(tmp_path / "laid")) == written(spark, str(tmp_path / "plain"))
    rows = J.events(spark, str(tmp_path / "laid")).select(
        F.regexp_extract(F.input_file_name(), r"_(\d{5})\.c000", 1).cast("int").alias("b"), F.expr("pmod(hash(event_id), 4)").alias("h"))
    assert rows.where("b = h").count() == 35 and rows.where("b != h OR b IS NULL").count() == 0
