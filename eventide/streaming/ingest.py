"""Streaming ingest of closed shards, and late rows.

A file source takes each file once, so producers land closed files.  For shards
that still grow, re-run the batch ingest: it adds only what is missing.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventide.params import IngestParams
from eventide.plans import ingest
from eventide.session import require_utc, scratch
from eventide.sources import journal as J
from eventide.sources import jsonl


def read_stream(spark: SparkSession, events_root: str, p: IngestParams, files_per_trigger: int | None = None) -> DataFrame:
    """Lines of new shard files."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    lines = reader.load(jsonl.shard_paths(events_root, p.glob)).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    return lines


def late_rows(rows: DataFrame, newest: dt.datetime | None, delay_s: float) -> DataFrame:
    """Rows created more than ``delay_s`` before the newest row of earlier batches."""
    if newest is None:
        return rows.limit(0)
    return rows.where(F.col("created_utc") < F.lit(newest - dt.timedelta(seconds=delay_s)))


def without_replays(lines: DataFrame, within: str) -> DataFrame:
    """Lines of a stream without JSON lines that it already brought within ``within`` of processing time: shards delivered again.

    The clock is that of the batches, so no line is ever too late and none is lost; the state holds a hash a line and is
    dropped after that time.  The merge into the journal stays the authority for what comes again later.  Lines that
    aren't JSON are left alone, since the quarantine counts their copies.
    """
    shown = F.trim("line")
    whole = shown.startswith("{") & F.get_json_object("line", "$").isNotNull()
    key = F.when(whole, F.sha2(shown, 256)).otherwise(F.uuid())
    told = lines.withColumns({"_at": F.current_timestamp(), "_line": key}).withWatermark("_at", within)
    return told.dropDuplicatesWithinWatermark(["_line"]).drop("_at", "_line")


def ingest_stream(
    spark: SparkSession,
    events_root: str,
    journal_root: str,
    checkpoint: str,
    p: IngestParams = IngestParams(),
    segments: DataFrame | None = None,
    late_after_s: float = 600.0,
    files_per_trigger: int | None = None,
    replays_within: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Journal new shard files as they land.

    Each micro-batch goes through the same steps as a batch ingest, with the
    same rule for recordings and the same quarantine, so a repeated batch, or a
    batch ingest of the same shards, adds nothing.  Late rows are journalled like any other
    and also listed in ``late/``.  ``replays_within`` (such as ``1 hour``) drops lines delivered again before they reach the journal:
    see :func:`without_replays`.  ``trigger`` as for ``DataStreamWriter``.
    """
    require_utc(spark)
    given = segments
    newest = J.newest_part(spark, journal_root).agg(F.max("created_utc")).first()[0]

    def write(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):  # a batch's own tables go with it
            write_batch(batch, batch_id)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        nonlocal newest
        session = batch.sparkSession
        # recordings are listed anew for each batch, as a batch ingest does
        known = ingest.known_segments(session, batch, p) if given is None else given
        landed = ingest.land(ingest.classified(jsonl.parse_lines(batch), p, known))
        late = late_rows(landed, newest, late_after_s).select("event_id", "source", "kind", "created_utc")
        # one folder per batch, replaced if the batch is repeated
        late.write.mode("overwrite").parquet(f"{journal_root}/late/batch={batch_id}")
        ingest.append(session, landed, known, journal_root, p)
        top = landed.agg(F.max("created_utc")).first()[0]
        newest = max(filter(None, (newest, top)), default=None)

    rows = read_stream(spark, events_root, p, files_per_trigger)
    if replays_within:
        rows = without_replays(rows, replays_within)
    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return writer.trigger(**(trigger or {"processingTime": "30 seconds"})).start()
