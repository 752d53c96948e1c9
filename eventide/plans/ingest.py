"""Shards to journal: normalise lines, join segments, append idempotently."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide import schema
from eventide.functions import payload as P
from eventide.functions.times import parse_ts, strip
from eventide.operators.dedupe import drop_windowed_duplicates
from eventide.params import IngestParams
from eventide.plans import incremental
from eventide.session import require_utc, scratch, stage
from eventide.sources import by_id, journal, jsonl
from eventide.sources.segments import list_files, list_segments, with_bounds


def empty_segments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schema.CLIPS)


NOT_JSON, NO_TIME = "not one JSON object", "no time"


def classified(parsed: DataFrame, p: IngestParams, segments: DataFrame) -> DataFrame:
    """Every parsed line (``file, line, obj``; other columns stay) once: a journal row, or a ``reason`` it cannot be one.

    Rows with a reason keep ``line``.  ``segments`` is the clip table of
    :func:`with_bounds`.  The segment of an event is the one its ``clip`` names
    or, without one, the recording its time falls in.
    """
    v = F.col("obj")
    ts = parse_ts(v["ts"])
    named = P.media_path(F.col("_clip"), F.regexp_replace("file", "^file:/+", "/"), p.clips_dir)
    guessed = P.segment_path(p.clips_dir, F.lit(p.camera_stub), F.col("_ts"), p.container_ext)
    x0, x1 = P.explicit_offsets(v)
    rows = parsed.withColumns({
        "kind": P.kind_of(v),
        "source": P.source_of(v, p.default_source),
        "_ts": ts,
        "created_utc": F.date_trunc("second", P.event_time(v)),
        "_clip": strip(P.text_of(v["clip"])),
        "_x0": x0, "_x1": x1,
        "novelty": v["novelty"],
        "confidence": v["confidence"],
        "payload": P.compact(F.col("line")),
    })
    reason = F.when(v.isNull(), NOT_JSON).when(F.col("created_utc").isNull(), NO_TIME)
    rows = rows.withColumn("reason", reason).withColumn("clip_path", F.coalesce(named, guessed))
    media = segments.select(F.col("path").alias("clip_path"), "clip_id", F.col("start_utc").alias("_seg"))
    rows = rows.join(media, "clip_path", "left").withColumn("clip_id", F.coalesce("clip_id", F.lit("")))
    t0, t1, basis = P.offsets(F.col("_ts"), F.col("_seg"), F.col("_x0"), F.col("_x1"), p.pre_ms, p.post_ms)
    rows = rows.withColumns({"t0_ms": t0, "t1_ms": t1, "offset_basis": basis})
    c = F.col
    return rows.withColumn(
        "event_id", P.event_id(c("source"), c("kind"), c("clip_id"), c("t0_ms"), c("payload"))
    ).drop("_ts", "_x0", "_x1", "_seg", "_clip")


def normalise(parsed: DataFrame, p: IngestParams, segments: DataFrame) -> DataFrame:
    """The journal rows of :func:`classified`."""
    return classified(parsed, p, segments).where(F.col("reason").isNull()).drop("reason", "line")


def untimed(parsed: DataFrame) -> DataFrame:
    """JSON objects without a usable time: quarantined, since no clock is made up for them."""
    rows = parsed.where(F.col("obj").isNotNull() & P.event_time(F.col("obj")).isNull())
    return rows.drop("obj").withColumn("line", F.left("line", F.lit(jsonl.QUARANTINE_CHARS)))


def quarantine_rows(landed: DataFrame) -> DataFrame:
    """Rows of ``quarantine/``: one for each different bad line of a file, the whole line's hash being part of its key.

    ``line_no`` is the first of the equal lines; it is null where lines are not numbered, as in a stream.
    """
    number = F.min("line_no") if "line_no" in landed.columns else F.lit(None)
    bad = landed.where(F.col("reason").isNotNull()).withColumn("quarantine_id", F.sha1(F.concat_ws("|", "file", F.sha1("line"))))
    return bad.groupBy("quarantine_id", "file", "reason").agg(
        number.cast("bigint").alias("line_no"), F.count(F.lit(1)).alias("copies"),
        F.first(F.left("line", F.lit(jsonl.QUARANTINE_CHARS))).alias("line"),
    ).select(*schema.QUARANTINE.names)


CAPTION = "text string, wav string, model string, lang string, sr int, start_utc string, end_utc string, created_utc string"


def caption_rows(events: DataFrame) -> DataFrame:
    """Captions of speech events; missing times fall back to the creation time."""
    body, created = F.col("_b"), F.col("created_utc")
    second = lambda t: F.date_trunc("second", t)
    made = F.coalesce(parse_ts(body["created_utc"]), created)
    speech = events.where(P.is_speech(F.col("kind"))).withColumn("_b", F.from_json("payload", CAPTION))
    return speech.select(
        "event_id",
        F.coalesce(body["text"], F.lit("")).alias("text"),
        body["model"].alias("model"),
        F.lit(None).cast("int").alias("tokens"),
        F.coalesce(body["wav"], F.lit("")).alias("wav"),
        second(F.coalesce(parse_ts(body["start_utc"]), made)).alias("start_utc"),
        second(F.coalesce(parse_ts(body["end_utc"]), made)).alias("end_utc"),
        body["sr"].alias("sr"),
        body["lang"].alias("lang"),
        second(made).alias("created_utc"),
    )


def event_rows(rows: DataFrame) -> DataFrame:
    return rows.select(*schema.EVENTS.names).withColumn(journal.DATE, F.to_date("created_utc"))


def clip_rows(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments some event points at."""
    used = rows.select("clip_id").distinct()  # no segment has the empty id
    return segments.join(used, "clip_id", "left_semi").select(*schema.CLIPS.names)


def plan(rows: DataFrame) -> DataFrame:
    """What an ingest would do, without doing it."""
    return rows.select("file", "line_no", "kind", "t0_ms", F.left("clip_id", F.lit(10)).alias("clip"))


@dataclass(frozen=True)
class IngestReport:
    """``candidates`` and ``quarantined`` together are the lines that are neither blank nor comments."""

    events: int
    captions: int
    clips: int
    candidates: int
    quarantined: int = 0

    @property
    def skipped(self) -> int:
        return self.candidates - self.events


def merge(spark: SparkSession, batch: DataFrame, segments: DataFrame, root: str, p: IngestParams) -> IngestReport:
    """Add a landed batch of event rows (:func:`event_rows`) to the three tables.

    Captions and clips go first: an interrupted run leaves no event without
    them, and running it again adds only what is missing.
    """
    candidates = batch.count()
    if p.dedupe_seconds is not None and p.dedupe_seconds >= 0:
        # equal payloads have equal times, so only the batch's dates can hold a duplicate
        known = journal.on_dates_of(journal.events(spark, root), batch)
        batch = drop_windowed_duplicates(batch, known, p.dedupe_seconds)
    caps = caption_rows(batch).withColumn(journal.DATE, F.to_date("created_utc"))
    n_caps = journal.append_new(caps, journal.captions(spark, root), f"{root}/captions", "event_id", journal.DATE)
    n_clips = journal.append_new(clip_rows(batch, segments), journal.clips(spark, root), f"{root}/clips", "clip_id")
    incremental.mark(batch, root)  # before, so that an interrupted run leaves no hour unmarked
    if p.id_buckets:
        by_id.lay_out(spark, root, p.id_buckets)
    if buckets := by_id.buckets_of(spark, root):
        n_events = by_id.append_new(batch, f"{root}/events", schema.EVENTS, "event_id", journal.DATE, buckets)
    else:
        n_events = journal.append_new(batch, journal.events(spark, root), f"{root}/events", "event_id", journal.DATE)
    if n_events:
        incremental.mark(batch, root)  # after, for a refresh that ran in between
        journal.write_digests(journal.on_dates_of(journal.events(spark, root), batch), root)
    return IngestReport(n_events, n_caps, n_clips, candidates)


def land(rows: DataFrame) -> DataFrame:
    """Classified rows written once, so that lines are parsed a single time."""
    place = [c for c in ("file", "line_no", "split", "row_id") if c in rows.columns]
    bad_line = F.when(F.col("reason").isNotNull(), F.col("line")).alias("line")
    kept = rows.select(*schema.EVENTS.names, "reason", *place, bad_line)
    return stage(kept.withColumn(journal.DATE, F.to_date("created_utc")))


def append(
    spark: SparkSession, landed: DataFrame, segments: DataFrame, root: str, p: IngestParams, scan: DataFrame | None = None
) -> IngestReport:
    """Merge landed rows into the journal, bad lines into ``quarantine/``; ``scan`` gives those their numbers."""
    bad = landed.where(F.col("reason").isNotNull())
    n_bad = bad.count()
    if n_bad:
        if scan is not None and "split" in bad.columns:
            bad = jsonl.number_lines(bad, scan)
        journal.append_new(quarantine_rows(bad), journal.quarantine(spark, root), f"{root}/quarantine", "quarantine_id")
    good = landed.where(F.col("reason").isNull()).select(*schema.EVENTS.names, journal.DATE)
    return replace(merge(spark, good, segments, root, p), quarantined=n_bad)


def known_segments(spark: SparkSession, lines: DataFrame, p: IngestParams) -> DataFrame:
    """The recordings under ``clips_dir``, and the files elsewhere that lines name as their clip: one rule for all ingests.

    Written once as a small table, so that its true size, not that of the media, decides how it is joined.
    """
    has_media = jsonl.pick_existing(spark, [p.clips_dir]) is not None
    found = list_segments(spark, p.clips_dir) if has_media else spark.createDataFrame([], "path string")
    return stage(with_bounds(found.unionByName(named_files(spark, lines, p)).distinct()))


def named_files(spark: SparkSession, lines: DataFrame, p: IngestParams) -> DataFrame:
    """Existing files outside ``clips_dir`` that a line's ``clip`` names: beside the shard, or by an absolute path.

    Their folders are listed, a folder a path; files are not read.
    """
    clip = strip(F.get_json_object("line", "$.clip"))
    file = F.regexp_replace("file", "^file:/+", "/")
    path = P.media_path(clip, file, p.clips_dir)
    named = lines.where(F.col("line").contains('"clip"')).select(path.alias("path")).where(
        F.col("path").isNotNull() & ~F.col("path").startswith(p.clips_dir.rstrip("/") + "/")).distinct()
    folders = named.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).where("folder != ''").distinct()
    there = [r.folder for r in folders.toLocalIterator() if jsonl.pick_existing(spark, [r.folder])]
    if not there:
        return spark.createDataFrame([], "path string")
    return list_files(spark, there).join(named, "path", "left_semi")


def ingest(
    spark: SparkSession,
    events_root: str,
    journal_root: str,
    p: IngestParams = IngestParams(),
    segments: DataFrame | None = None,
) -> IngestReport:
    """One-shot ingest of all shards under a root; safe to repeat, also over growing shards."""
    require_utc(spark)
    with scratch(spark):
        return _ingest(spark, events_root, journal_root, p, segments)


def _ingest(
    spark: SparkSession, events_root: str, journal_root: str, p: IngestParams, segments: DataFrame | None
) -> IngestReport:
    scan = lines = jsonl.scan_lines(spark, jsonl.shard_paths(events_root, p.glob))
    if p.limit:
        lines = jsonl.first_lines(jsonl.number_lines(lines, lines), p.limit)
    if segments is None:
        segments = known_segments(spark, lines, p)
    landed = land(classified(jsonl.parse_lines(lines), p, segments))
    return append(spark, landed, segments, journal_root, p, scan)


def dry_run(
    spark: SparkSession, events_root: str, p: IngestParams = IngestParams(), segments: DataFrame | None = None
) -> DataFrame:
    """What :func:`ingest` would journal, line by line; nothing is written to the journal."""
    require_utc(spark)
    lines = jsonl.scan_lines(spark, jsonl.shard_paths(events_root, p.glob))
    lines = jsonl.number_lines(lines, lines)
    if p.limit:
        lines = jsonl.first_lines(lines, p.limit)
    if segments is None:
        segments = known_segments(spark, lines, p)
    return plan(normalise(jsonl.parse_lines(lines), p, segments))
