"""Job parameters.  Defaults are fixed values: the shipped configuration."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class IngestParams:
    glob: str = "*/*.jsonl"
    camera_stub: str = "cam_sim"
    container_ext: str = "mkv"
    clips_dir: str = "/record"
    pre_ms: int = 2000
    post_ms: int = 3000
    limit: int | None = None
    dedupe_seconds: float | None = None
    default_source: str = "stage2"
    id_buckets: int | None = None  # lay a new journal's events out by id, in so many buckets a date


@dataclass(frozen=True)
class PerceptionParams:
    # motion gate
    motion_threshold: float = 0.35
    min_motion_frames: int = 1
    min_motion_area_frac: float = 0.0
    # novelty
    phash_distance_max: int = 8
    novelty_window_s: float = 20.0
    # detector
    cadence_fps: float = 10.0
    conf_threshold: float = 0.2
    max_detections: int = 20
    labels: tuple[str, ...] = ("person", "dog", "cat")
    # tracker
    iou_threshold: float = 0.3
    track_ttl_s: float = 2.0
    # events
    side_margin_frac: float = 0.15
    cooldown_s: float = 2.0
    min_track_frames: int = 2
    min_track_area_px: float = 1500.0
    presence_hold_s: float = 3.0
    merge_grace_s: float = 4.0
    clip_pre_s: float = 3.0
    clip_post_s: float = 3.0
    min_event_sec: float = 1.0
    # trailing buffer
    buffer_s: float = 12.0
    buffer_bytes: int = 256 * 1024 * 1024
    # event text
    source: str = "cam_sim"
    local_tz: str = "UTC"
    # length of the time blocks one camera's history is split into
    block_s: float = 3600.0
    # blocks a stretch without a pause may reach over before it is matched block by block
    max_segment_blocks: int = 12

    def sensitive(self) -> "PerceptionParams":
        """The sensitive profile: lower motion threshold, denser detector passes."""
        return replace(
            self,
            motion_threshold=min(0.08, self.motion_threshold),
            cadence_fps=max(4.0, self.cadence_fps),
        )


@dataclass(frozen=True)
class TrendParams:
    baseline_days: int = 7
    min_days: int = 3
    stale_after_days: int = 2
    z_threshold: float = 3.0
    mix_threshold: float = 0.3
    shift_threshold: float = 0.2
    retention_days: int = 7
    caption_similarity: float = 0.8
    min_speech_s: float = 0.5
    min_level: float = 0.0
