"""Lifecycle of tracks on streams: enter, exit and summary lines as frames come (H2-H5).

A camera's live tracks are a table in map state, by birth; what a batch of rows leaves untouched is neither written nor
copied.  Rows are taken in event-time order, so lines equal those of the batch operators for everything that is not late.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

from eventide.functions import geometry as G
from eventide.operators import asof, blocks, perception_events
from eventide.operators.tracks import FrameMatcher
from eventide.params import PerceptionParams
from eventide.streaming.stateful import InOrder, _run, _times

FRAME, DETECTION = 0, 1
_BOX = ["x1", "y1", "x2", "y2"]


class Lifecycle(InOrder):
    """Tracks of one camera, all classes: matched by class, numbered together in order of birth."""

    keys = ["camera"]
    columns = ["us", "frame_idx", "kind", "det_idx", "label", "conf", *_BOX, "side", "big"]
    row_schema = (
        "us long, frame_idx long, kind int, det_idx long, label string, conf double, x1 double, y1 double, x2 double, y2 double, "
        "side string, big boolean")
    birth_schema = "label string, birth_us long, birth_frame long, birth_det long"
    track_schema = (
        "tid long, x1 double, y1 double, x2 double, y2 double, us long, n long, first_side string, last_side string, "
        "enter_us long, enter_conf double, ex1 double, ey1 double, ex2 double, ey2 double")
    output = [
        "entered", "tid", "cls", "enter_us", "enter_conf", "ex1", "ey1", "ex2", "ey2", "first_side", "last_side", *_BOX, "exit_us"]

    def __init__(self, p: PerceptionParams, idle_s: float | None = None):
        self.iou_threshold, self.ttl, self.kth = p.iou_threshold, blocks.micros(p.track_ttl_s), p.min_track_frames
        self.idle = None if idle_s is None else blocks.micros(idle_s)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row_schema)
        self.table = handle.getMapState("tracks", self.birth_schema, self.track_schema)
        self.clock = handle.getValueState("clock", "frame_us long, tracks long")

    @staticmethod
    def place(row):
        return row[:5]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        due = self._due(limit)
        frame_us, born = tuple(self.clock.get()) if self.clock.exists() else (None, 0)
        rests = None if self.idle is None or frame_us is None else frame_us + self.idle
        if not due and (rests is None or rests >= limit):
            return iter([])
        scene = Scene(self, {tuple(k): tuple(v) for k, v in self.table.iterator()} if self.table.exists() else {}, frame_us, born)
        for frame in frames_of(due):
            scene.frame(frame)
        scene.silence(limit)
        for birth in scene.gone:
            self.table.removeKey(birth)
        for birth in scene.changed - scene.gone:
            self.table.updateValue(birth, scene.value(birth))
        self.clock.update((scene.frame_us, scene.born))
        if self.idle is not None and scene.tracks and scene.frame_us is not None:
            self._wake(scene.frame_us + self.idle)
        return self._named(key, scene.out)


def frames_of(rows: list[tuple]) -> Iterator[list[tuple]]:
    """Rows of equal time and frame together."""
    i = 0
    while i < len(rows):
        j = i
        while j < len(rows) and rows[j][:2] == rows[i][:2]:
            j += 1
        yield rows[i:j]
        i = j


class Scene:
    """The table of tracks while some rows are taken."""

    def __init__(self, rule: Lifecycle, table: dict[tuple, tuple], frame_us: int | None, born: int):
        self.rule, self.frame_us, self.born = rule, frame_us, born
        self.tracks: dict[tuple, dict] = {}
        self.matchers: dict[str, FrameMatcher] = {}
        self.changed: set[tuple] = set()
        self.gone: set[tuple] = set()
        self.out: list[tuple] = []
        for birth in sorted(table, key=lambda b: table[b][0]):
            v = table[birth]
            track = {"birth": birth, "tid": v[0], "box": tuple(v[1:5]), "us": v[5], "n": v[6], "first_side": v[7], "last_side": v[8],
                     "enter": None if v[9] is None else tuple(v[9:15])}
            self.tracks[birth] = track
            self._matcher(birth[0]).live.append(track)

    def value(self, birth: tuple) -> tuple:
        t = self.tracks[birth]
        return (t["tid"], *t["box"], t["us"], t["n"], t["first_side"], t["last_side"], *(t["enter"] or (None,) * 6))

    def _matcher(self, label: str) -> FrameMatcher:
        if label not in self.matchers:
            self.matchers[label] = FrameMatcher(self.rule.iou_threshold, self.rule.ttl)
        return self.matchers[label]

    def silence(self, us: int) -> None:
        """An empty frame stands where the camera has been silent for the idle time by ``us``."""
        if self.rule.idle is not None and self.frame_us is not None and us > self.frame_us + self.rule.idle:
            self.exits(self.frame_us + self.rule.idle)

    def exits(self, us: int) -> None:
        for birth, t in list(self.tracks.items()):
            if us > t["us"] + self.rule.ttl:
                self.out.append(self._row(t, us))
                del self.tracks[birth]
                self.gone.add(birth)

    def frame(self, rows: list[tuple]) -> None:
        us, dets = rows[0][0], [r for r in rows if r[2] == DETECTION]
        self.silence(us)
        if len(dets) < len(rows):
            self.exits(us)
            self.frame_us = us
        new = []
        for label in sorted({r[4] for r in dets}):
            mine = [r for r in dets if r[4] == label]
            births = [(label, r[0], r[1], r[3]) for r in mine]
            for r, t in zip(mine, self._matcher(label).frame(us, [r[6:10] for r in mine], births), strict=True):
                if t["n"] == 1:
                    t.update(first_side=r[10], enter=None)
                    new.append((r[3], label, t))
                t["last_side"] = r[10]
                self.changed.add(t["birth"])
                if t["n"] == self.rule.kth and r[11]:
                    t["enter"] = (us, r[5], *r[6:10])
        for _, _, t in sorted(new, key=lambda x: x[:2]):
            self.born += 1
            t["tid"] = self.born
            self.tracks[t["birth"]] = t
        entered = [t for b, t in self.tracks.items() if b in self.changed and t["enter"] and t["enter"][0] == us and t["us"] == us]
        self.out += [self._row(t, None) for t in entered if t["n"] == self.rule.kth]

    def _row(self, t: dict, exit_us: int | None) -> tuple:
        return (exit_us is None, t["tid"], t["birth"][0], *(t["enter"] or (None,) * 6), t["first_side"], t["last_side"], *t["box"], exit_us)


def with_silence(frames: DataFrame, idle_s: float, block_s: float = 3600.0) -> DataFrame:
    """Frames and an empty one wherever a camera is silent for longer than ``idle_s``, that long after its last frame.

    The end of a camera's frames is a silence if another camera goes on for longer.  Batch twin of ``idle_s`` below; runs a job.
    """
    times = frames.select("camera", "ts").distinct()
    until = frames.agg(F.max("ts")).first()[0]
    after = F.timestamp_micros(F.unix_micros("ts") + blocks.micros(idle_s))
    gaps = asof.next_frame_after(times, frames, "ts", "_next", block_s).where(F.coalesce("_next", F.lit(until)) > after)
    return times.unionByName(gaps.select("camera", after.alias("ts")))


def track_changes(
    frames: DataFrame, dets: DataFrame, p: PerceptionParams, delay: str = "10 seconds", idle_s: float | None = None
) -> DataFrame:
    """Enters and exits of tracks, from a stream of frames (camera, ts, frame_idx) and one of detections.

    An enter has no ``exit_ts``; it comes with the detection that makes it.  An exit comes with the camera's first frame after the time to
    live.  With ``idle_s``, a camera without a frame for longer counts as having an empty one that long after its last, once the watermark
    is past that time.
    """
    c = F.col
    # no nulls: a column of whole numbers with nulls would reach the state as floats
    none = {"det_idx": F.lit(-1).cast("long"), "label": F.lit(""), **{n: F.lit(0.0) for n in ("conf", *_BOX)}, "side": F.lit(""), "big": F.lit(False)}
    f = frames.select("camera", "ts", c("frame_idx").cast("long"), F.lit(FRAME).alias("kind"), *[v.alias(n) for n, v in none.items()])
    side = G.side(G.center_x(c("x1"), c("x2")), c("img_w"), p.side_margin_frac)
    big = G.area(*map(c, _BOX)) >= p.min_track_area_px
    d = dets.select(
        "camera", "ts", c("frame_idx").cast("long"), F.lit(DETECTION).alias("kind"), c("det_idx").cast("long"), c("cls").alias("label"),
        "conf", *_BOX, side.alias("side"), big.alias("big"))
    rows = f.unionByName(d)
    out = _run(
        rows, Lifecycle(p, idle_s),
        "camera string, entered boolean, tid long, cls string, enter_us long, enter_conf double, ex1 double, ey1 double, ex2 double, "
        "ey2 double, first_side string, last_side string, x1 double, y1 double, x2 double, y2 double, exit_us long", delay)
    out = _times(out, "enter_us", "exit_us")
    stayed = (F.unix_micros("exit_ts") - F.unix_micros("enter_ts")) / F.lit(1e6)
    return out.withColumns({
        "enter_bbox": F.array("ex1", "ey1", "ex2", "ey2"), "last_bbox": F.array(*_BOX), "duration_s": stayed,
        "exit_side": G.exit_side(c("first_side"), c("last_side")), "exit_reason": G.exit_reason(c("first_side"), c("last_side")),
    }).drop("ex1", "ey1", "ex2", "ey2", *_BOX)


def track_line_stream(
    frames: DataFrame, dets: DataFrame, p: PerceptionParams, delay: str = "10 seconds", idle_s: float | None = None
) -> DataFrame:
    """track.enter, track.exit and object.summary lines of a stream, as :func:`track_changes` finds them."""
    return perception_events.track_events(track_changes(frames, dets, p, delay, idle_s), p, enters=F.col("entered"))
