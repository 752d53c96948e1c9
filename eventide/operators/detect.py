"""Per-frame detection filtering and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions.signals import on_cadence
from eventide.params import PerceptionParams


def filter_detections(dets: DataFrame, p: PerceptionParams) -> DataFrame:
    """Confidence floor, then the best ``max_detections`` per frame, then the label list."""
    w = Window.partitionBy("camera", "frame_idx").orderBy(F.col("conf").desc(), "det_idx")
    top = (
        dets.where(F.col("conf") >= p.conf_threshold)
        .withColumn("_rank", F.row_number().over(w))
        .where(F.col("_rank") <= p.max_detections)
        .drop("_rank")
    )
    return top.where(F.col("cls").isin(*p.labels)) if p.labels else top


def sample_frames(frames: DataFrame, fps: float, p: PerceptionParams) -> DataFrame:
    """Frames the detector runs on."""
    return frames.where(on_cadence(F.col("frame_idx"), fps, p.cadence_fps))


def frame_objects(dets: DataFrame) -> DataFrame:
    """Sorted distinct classes per frame."""
    return dets.groupBy("camera", "frame_idx").agg(F.array_sort(F.collect_set("cls")).alias("objects"))


def attach_objects(frames: DataFrame, dets: DataFrame) -> DataFrame:
    """Frames with their object set; frames without detections get an empty one."""
    return (
        frames.drop("objects")
        .join(frame_objects(dets), ["camera", "frame_idx"], "left")
        .withColumn("objects", F.coalesce("objects", F.array().cast("array<string>")))
    )
