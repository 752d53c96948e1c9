"""Motion labels, gates, hash distance, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def motion_label(score: Column) -> Column:
    return (
        F.when(score < 0.10, "none").when(score < 0.25, "minor").when(score < 0.50, "clear").otherwise("heavy")
    )


def over_gate(motion: Column, threshold: float, min_area: float = 0.0) -> Column:
    """Motion below the area floor counts as none."""
    return F.when(motion >= min_area, motion).otherwise(F.lit(0.0)) >= threshold


def cadence_interval(fps: float, cadence_fps: float) -> int:
    """Every how many frames the detector runs."""
    return max(1, round((fps or 15.0) / max(0.5, cadence_fps)))


def on_cadence(frame_idx: Column, fps: float, cadence_fps: float) -> Column:
    return frame_idx % cadence_interval(fps, cadence_fps) == 0


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def excitement(avg_motion: Column, speech_s: Column) -> Column:
    return avg_motion * 100.0 + speech_s


def excitement_basis(avg_motion: Column, speech_s: Column) -> Column:
    m = avg_motion * 100.0
    return (
        F.when(m + speech_s <= 0, "none")
        .when(m > speech_s * 2, "motion")
        .when(speech_s > m * 2, "speech")
        .otherwise("mixed")
    )
