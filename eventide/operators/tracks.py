"""Multi-object tracking over detections (C7, H2) and its track table.

Matching is greedy within a camera and class and forgets a track once nothing
matched it for the time to live.  So time can be cut wherever a (camera, class)
pauses for longer than that: no track crosses such a cut.  Each time block is
cut at its first pause; rows between two cuts form one segment.  Segments are
spread over tasks and streamed in time order, with memory for the live tracks
only.  A segment over many blocks, a scene that never rests, is matched block
by block: see :mod:`eventide.operators.long_segments`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions import geometry as G
from eventide.operators import asof, blocks
from eventide.operators.batches import starts, whole_groups
from eventide.operators.blocks import BLOCK
from eventide.params import PerceptionParams
from eventide.session import stage

SCOPE = ["camera", "cls"]
SEGMENT = "_segment"
FIRST = -(1 << 62)  # segment before a scope's first pause
BIRTH = ["birth_ts", "birth_frame", "birth_det"]

_IN = ["camera", "cls", SEGMENT, "frame_idx", "ts", "_us", "det_idx", "conf", "x1", "y1", "x2", "y2", "img_w"]
_OUT = (
    "camera string, cls string, frame_idx long, ts timestamp, det_idx int, conf double, "
    "x1 double, y1 double, x2 double, y2 double, img_w int, "
    "birth_ts timestamp, birth_frame long, birth_det int, match_no int"
)


def _cuts(b: DataFrame, p: PerceptionParams) -> DataFrame:
    """Per (scope, block): its first pause, and the segment open when the block begins."""
    ttl = blocks.micros(p.track_ttl_s)
    pause = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(blocks.within(SCOPE, "ts")))
    cuts = (
        b.select(*SCOPE, BLOCK, "ts")
        .withColumn("_cut", F.when(pause > ttl, F.col("ts")))
        .groupBy(*SCOPE, BLOCK)
        .agg(F.min("_cut").alias("_cut"))
    )
    earlier = Window.partitionBy(*SCOPE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    begun = F.last(F.when(F.col("_cut").isNotNull(), F.col(BLOCK)), ignorenulls=True).over(earlier)
    return cuts.withColumn("_open", F.coalesce(begun, F.lit(FIRST)))


def _long_segments(cuts: DataFrame, most: int) -> DataFrame:
    """Segments that reach over more than ``most`` blocks."""
    own = F.when(F.col("_cut").isNotNull(), F.col(BLOCK))
    touched = cuts.select(*SCOPE, BLOCK, F.explode(F.array_compact(F.array("_open", own))).alias(SEGMENT))
    span = F.max(BLOCK) - F.min(BLOCK) + 1
    return touched.groupBy(*SCOPE, SEGMENT).agg(span.alias("_span")).where(F.col("_span") > most).drop("_span")


def with_segments(b: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds the segment a (blocked) detection belongs to."""
    seg = F.when(F.col("ts") >= F.col("_cut"), F.col(BLOCK)).otherwise(F.col("_open"))
    return blocks.join_carry(b, cuts, SCOPE).withColumn(SEGMENT, seg).drop("_cut", "_open")


class FrameMatcher:
    """Live tracks of one (camera, class) and the matching of one frame against them."""

    def __init__(self, iou_threshold: float, ttl_us: int):
        self.iou_threshold = iou_threshold
        self.ttl_us = ttl_us
        self.live: list[dict] = []

    def overlap(self, a: tuple, b: tuple) -> float:
        w = min(a[2], b[2]) - max(a[0], b[0])
        h = min(a[3], b[3]) - max(a[1], b[1])
        both = w * h if w > 0 and h > 0 else 0.0
        whole = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1])
        return both / (whole - both + G.IOU_EPS)

    def frame(self, us: int, boxes: list[tuple], births: list[tuple]) -> list[dict]:
        """Track of every box, in box order; unmatched boxes start tracks after all matching."""
        self.live = [t for t in self.live if us - t["us"] <= self.ttl_us]
        free = list(self.live)
        found: list[dict | None] = []
        for box in boxes:
            scored = [(self.overlap(t["box"], box), -i) for i, t in enumerate(free)]
            score, at = max(scored, default=(0.0, 0))
            if score > 0.0 and score >= self.iou_threshold:
                track = free.pop(-at)
                track.update(box=box, us=us, n=track["n"] + 1, last=births[len(found)])
                found.append(track)
            else:
                found.append(None)
        for i, track in enumerate(found):
            if track is None:
                track = {"box": boxes[i], "us": us, "n": 1, "birth": births[i], "last": births[i]}
                self.live.append(track)
                found[i] = track
        return found


def _matcher(iou_threshold: float, ttl_us: int):
    """Task function: sorted batches in, the same rows with their track out."""
    scope_key = ["camera", "cls", SEGMENT]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scope, matcher = None, None
        for pdf, frames in whole_groups(batches, [*scope_key, "_us", "frame_idx"]):
            boxes = list(zip(*(pdf[c].to_numpy() for c in ("x1", "y1", "x2", "y2"))))
            births = list(zip(pdf["ts"], pdf["frame_idx"], pdf["det_idx"]))
            us, scope_at = pdf["_us"].to_numpy(), set(starts(pdf, scope_key).tolist())
            found: list[tuple] = []
            for i, j in zip(frames, [*frames[1:], len(pdf)]):
                if i in scope_at:
                    here = tuple(None if pd.isna(v) else v for v in pdf.loc[i, scope_key])
                    if here != scope:
                        scope, matcher = here, FrameMatcher(iou_threshold, ttl_us)
                found += [(t["birth"], t["n"]) for t in matcher.frame(int(us[i]), boxes[i:j], births[i:j])]
            yield pdf.drop(columns=[SEGMENT, "_us"]).assign(
                birth_ts=pd.Series([b[0] for b, _ in found], index=pdf.index, dtype=pdf["ts"].dtype),
                birth_frame=[b[1] for b, _ in found],
                birth_det=[b[2] for b, _ in found],
                match_no=[n for _, n in found],
            )

    return run


def match_detections(dets: DataFrame, p: PerceptionParams) -> DataFrame:
    """Every (filtered) detection with the birth detection of its track and its match number."""
    from eventide.operators import long_segments

    b = blocks.with_block(dets.withColumn("_us", F.unix_micros("ts")), p.block_s)
    cuts = stage(_cuts(b, p))
    rows = with_segments(b, cuts)
    busy = _long_segments(cuts, p.max_segment_blocks)
    if busy.isEmpty():
        return _match_whole(rows, p)
    key = [*SCOPE, SEGMENT]
    rest = _match_whole(rows.join(busy, key, "left_anti"), p)
    return rest.unionByName(long_segments.match(rows.join(busy, key, "left_semi"), p).select(*rest.columns))


def _match_whole(rows: DataFrame, p: PerceptionParams) -> DataFrame:
    """Segments matched in one go each."""
    ordered = rows.select(*_IN).repartition(*SCOPE, SEGMENT).sortWithinPartitions(
        *SCOPE, SEGMENT, "_us", "frame_idx", "det_idx"
    )
    return ordered.mapInPandas(_matcher(p.iou_threshold, blocks.micros(p.track_ttl_s)), _OUT)


def tracks(dets: DataFrame, frames: DataFrame, p: PerceptionParams) -> DataFrame:
    """One row per track.

    Enter columns are set when the track had a large enough box at its
    ``min_track_frames``-th match; ``exit_ts`` is the camera's first frame after
    the time to live, NULL while the track is still live at the end of input.
    ``tid`` numbers a camera's tracks in order of birth.
    """
    hits = match_detections(dets, p)
    cx = G.center_x(F.col("x1"), F.col("x2"))
    hits = hits.withColumn("side", G.side(cx, F.col("img_w"), p.side_margin_frac)).withColumn(
        "bbox", F.array("x1", "y1", "x2", "y2")
    )
    kth = F.col("match_no") == p.min_track_frames
    big = G.area(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")) >= p.min_track_area_px
    enter = F.when(kth & big, F.struct("ts", "frame_idx", "conf", "bbox"))
    t = hits.groupBy("camera", "cls", *BIRTH).agg(
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count(F.lit(1)).alias("matches"),
        F.min_by("side", "match_no").alias("first_side"),
        F.max_by("side", "match_no").alias("last_side"),
        F.max_by("bbox", "match_no").alias("last_bbox"),
        F.max_by("conf", "match_no").alias("last_conf"),
        F.max(enter).alias("_enter"),
    )
    t = (
        t.withColumn("enter_ts", F.col("_enter.ts"))
        .withColumn("enter_conf", F.col("_enter.conf"))
        .withColumn("enter_bbox", F.col("_enter.bbox"))
        .drop("_enter")
        .withColumn("exit_side", G.exit_side(F.col("first_side"), F.col("last_side")))
        .withColumn("exit_reason", G.exit_reason(F.col("first_side"), F.col("last_side")))
    )
    t = stage(t)  # read several times below; tracking must run once
    gone = F.timestamp_micros(F.unix_micros("last_ts") + blocks.micros(p.track_ttl_s))
    out = asof.next_frame_after(t.withColumn("_gone", gone), frames, "_gone", "exit_ts", p.block_s)
    out = blocks.number(out, ["camera"], [*BIRTH, "cls"], "tid", p.block_s, "birth_ts", counted=t)
    stayed = (F.unix_micros("exit_ts") - F.unix_micros("enter_ts")) / F.lit(1e6)
    return out.withColumn("duration_s", stayed).drop("_gone", "birth_frame", "birth_det")


def mark_presence(frames: DataFrame, track_table: DataFrame, p: PerceptionParams) -> DataFrame:
    """Adds ``presence``: objects in the frame, or a track still live at it."""
    spans = track_table.withColumn(
        "_until", F.timestamp_micros(F.unix_micros("last_ts") + blocks.micros(p.track_ttl_s))
    )
    seen = asof.covered(frames, spans, "first_ts", "_until", "_tracked", p.block_s)
    return seen.withColumn("presence", F.col("_tracked") | (F.coalesce(F.size("objects"), F.lit(0)) > 0)).drop(
        "_tracked"
    )
