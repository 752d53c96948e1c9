"""Frames and detections to event lines, as one job with tables between its steps."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.operators import blocks, bursts, detect, gate, perception_events, tracks, trailing
from eventide.params import PerceptionParams
from eventide.session import require_utc, scratch, stage
from eventide.sources import jsonl


def frame_labels(frames: DataFrame, p: PerceptionParams) -> DataFrame:
    """Frames with motion label, gate, novelty and hash distance."""
    from eventide.functions.signals import motion_label, over_gate

    motion = F.col("motion")
    return trailing.novelty(frames, p).withColumns({
        "motion_label": motion_label(motion),
        "over": over_gate(motion, p.motion_threshold, p.min_motion_area_frac),
    })


def perceive(
    spark: SparkSession, frames: DataFrame, dets: DataFrame, out_root: str, p: PerceptionParams, roll: str = "hour",
    fps: float | None = None, block_rows: int = 500_000,
) -> None:
    """Write ``tracks/``, ``bursts/`` (parquet) and ``events/`` (JSON-lines shards), and ``frame_labels/`` of hashed frames.

    Each step reads the table the one before wrote, so nothing is computed twice
    and a failed job resumes from stored data.  With the frames' rate ``fps``,
    detections count on the frames of the detector's cadence only.
    """
    require_utc(spark)
    with scratch(spark):
        _perceive(spark, frames, dets, out_root, p, roll, fps, block_rows)


def _perceive(
    spark: SparkSession, frames: DataFrame, dets: DataFrame, out_root: str, p: PerceptionParams, roll: str, fps: float | None,
    block_rows: int,
) -> None:
    # blocks by what the busiest camera has, not shorter than what an operator looks back over
    back = max(p.novelty_window_s, p.buffer_s, p.cooldown_s, p.presence_hold_s, p.merge_grace_s, p.track_ttl_s, 1.0)
    p = replace(p, block_s=blocks.fitted(frames, ["camera"], p.block_s, rows=block_rows, least_s=back))
    if fps is not None:
        dets = detect.sample_frames(dets, fps, p)
    if "phash" in frames.columns:
        frame_labels(frames, p).write.mode("overwrite").parquet(f"{out_root}/frame_labels")
    kept = stage(detect.filter_detections(dets, p))
    tracks.tracks(kept, frames, p).write.mode("overwrite").parquet(f"{out_root}/tracks")
    track_table = spark.read.parquet(f"{out_root}/tracks")
    seen = stage(tracks.mark_presence(detect.attach_objects(frames, kept), track_table, p))
    bursts.bursts(gate.live_frames(seen, p), p).write.mode("overwrite").parquet(f"{out_root}/bursts")
    burst_table = spark.read.parquet(f"{out_root}/bursts")
    lines = perception_events.track_events(track_table, p).unionByName(
        perception_events.burst_events(burst_table, p))
    jsonl.write_shards(lines, f"{out_root}/events", roll, p.local_tz, mode="overwrite")
