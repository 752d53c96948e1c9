"""Exact sequential rules on streams: bursts, tracks, novelty.

Rows of a key wait in state until the watermark has passed them and are then
taken in event-time order, so the results equal the batch operators for
everything that is not late.  State holds the waiting rows and what the rule
itself remembers: an open burst, live tracks, or the hashes of the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from eventide.functions.times import add_seconds
from eventide.operators import blocks, perception_events
from eventide.operators.tracks import FrameMatcher
from eventide.params import PerceptionParams

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


class InOrder(StatefulProcessor):
    """Buffers a key's rows and hands them to :meth:`advance` in event-time order."""

    row_schema: str
    rule_schema: str
    columns: list[str]
    output: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row_schema)
        self.rule = handle.getListState("rule", self.rule_schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            if len(pdf):
                self.waiting.appendList(list(pdf[self.columns].itertuples(index=False, name=None)))
                self._wake(int(pdf["us"].min()))
        return iter([])

    def _wake(self, us: int) -> None:
        """Timer for when the watermark has passed the earliest waiting row."""
        self.handle.registerTimer(us // 1000 + 1)

    def _due(self, limit: int) -> list[tuple]:
        """Waiting rows before ``limit``, in order; the others go on waiting."""
        rows = sorted((tuple(r) for r in self.waiting.get()), key=self.place) if self.waiting.exists() else []
        due, later = [r for r in rows if r[0] < limit], [r for r in rows if r[0] >= limit]
        if due and later:
            self.waiting.put(later)
        elif due:
            self.waiting.clear()
        if later:
            self._wake(later[0][0])
        return due

    @staticmethod
    def place(row: tuple):
        return row

    def _named(self, key, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if not out:
            return iter([])
        pdf = pd.DataFrame(out, columns=self.output)
        for name, value in zip(self.keys, key):
            pdf.insert(0, name, value)
        return iter([pdf[[*self.keys, *self.output]]])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        due = self._due(limit)
        memory = [tuple(r) for r in self.rule.get()] if self.rule.exists() else []
        rests = self.silence(memory)
        if not due and (rests is None or rests >= limit):
            return iter([])
        memory, out = self.advance(due, memory, limit)
        if memory:
            self.rule.put(memory)
        else:
            self.rule.clear()
        rests = self.silence(memory)
        if rests is not None:
            self._wake(rests)
        return self._named(key, out)

    def silence(self, memory: list[tuple]) -> int | None:
        """When the key will have been silent for so long that the rule has something to say; None for never."""
        return None

    def advance(self, rows: list[tuple], memory: list[tuple], limit: int) -> tuple[list[tuple], list[tuple]]:
        """New memory and output of rows in order, and of the silence up to ``limit``."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class Bursts(InOrder):
    keys = ["camera"]
    columns = ["us", "frame_idx", "live", "presence", "motion", "objects"]
    row_schema = "us long, frame_idx long, live boolean, presence boolean, motion double, objects string"
    # one row: the open burst, if any, the last presence, the last row
    rule_schema = (
        "open boolean, start long, last_live long, last_pres long, peak double, objects string, frames long, "
        "motion0 double, objects0 string, last_row long")
    output = [
        "start_us", "last_live_us", "close_us", "peak_motion", "objects", "live_frames", "first_motion", "first_objects",
        "last_row_us", "flushed"]

    def __init__(self, p: PerceptionParams, idle_s: float | None = None):
        self.grace, self.hold = blocks.micros(p.merge_grace_s), blocks.micros(p.presence_hold_s)
        self.idle = None if idle_s is None else blocks.micros(idle_s)

    def silence(self, memory):
        return memory[0][-1] + self.idle if self.idle is not None and memory and memory[0][0] else None

    def advance(self, rows, memory, limit):
        """A row when a burst starts, without ``close_us``, and one when it closes or is flushed.

        A camera that is silent for longer than the idle time has ended: what comes after begins anew.
        """
        fresh = (False, 0, 0, None, 0.0, "", 0, 0.0, "", None)
        is_open, start, last, pres, peak, objects, n, m0, o0, seen = memory[0] if memory else fresh
        out = []
        for us, _, live, presence, motion, objs in [*rows, (limit, None, None, None, None, None)]:
            if self.idle is not None and seen is not None and us > seen + self.idle:
                if is_open:
                    out.append((start, last, None, peak, objects, n, m0, o0, seen, True))
                is_open, pres = False, None
            if live is None:
                break
            seen = us
            if presence:
                pres = us
            if live:
                if not is_open:
                    is_open, start, peak, objects, n, m0, o0 = True, us, motion, "", 0, motion, objs
                    out.append((us, us, None, motion, objs, 1, m0, o0, us, False))
                last, peak, n = us, max(peak, motion), n + 1
                objects = "/".join(sorted({*objects.split("/"), *objs.split("/")} - {""}))
            elif is_open and us - last >= self.grace and (pres is None or us - pres >= self.hold):
                out.append((start, last, us, peak, objects, n, m0, o0, us, False))
                is_open = False
        return [(is_open, start, last, pres, peak, objects, n, m0, o0, seen)], out


class Tracks(InOrder):
    keys = ["camera", "label"]  # a key named cls breaks Row(**fields)
    columns = ["us", "frame_idx", "det_idx", "x1", "y1", "x2", "y2"]
    row_schema = "us long, frame_idx long, det_idx long, x1 double, y1 double, x2 double, y2 double"
    rule_schema = "x1 double, y1 double, x2 double, y2 double, us long, n long, b_us long, b_frame long, b_det long"
    output = ["us", "frame_idx", "det_idx", "birth_us", "birth_frame", "birth_det", "match_no"]

    def __init__(self, p: PerceptionParams):
        self.iou_threshold, self.ttl = p.iou_threshold, blocks.micros(p.track_ttl_s)

    def advance(self, rows, memory, limit):
        m = FrameMatcher(self.iou_threshold, self.ttl)
        m.live = [{"box": r[:4], "us": r[4], "n": r[5], "birth": tuple(r[6:])} for r in memory]
        out, i = [], 0
        while i < len(rows):
            j = i
            while j < len(rows) and rows[j][:2] == rows[i][:2]:
                j += 1
            frame = rows[i:j]
            found = m.frame(frame[0][0], [r[3:] for r in frame], [r[:3] for r in frame])
            out += [(*r[:3], *t["birth"], t["n"]) for r, t in zip(frame, found)]
            i = j
        return [(*t["box"], t["us"], t["n"], *t["birth"]) for t in m.live], out


class Novelty(InOrder):
    keys = ["camera"]
    columns = ["us", "frame_idx", "phash"]
    row_schema = rule_schema = "us long, frame_idx long, phash long"
    output = ["us", "frame_idx", "hash_distance", "novelty"]

    def __init__(self, p: PerceptionParams):
        self.window, self.limit = blocks.micros(p.novelty_window_s), p.phash_distance_max

    def advance(self, rows, memory, limit):
        out = []
        for us, idx, h in rows:
            memory = [r for r in memory if us - r[0] <= self.window]
            d = min((((h ^ r[2]) & 0xFFFFFFFFFFFFFFFF).bit_count() for r in memory), default=None)
            out.append((us, idx, d, "duplicate" if d is not None and d <= self.limit else "new"))
            memory.append((us, idx, h))
        return memory, out


def _run(df: DataFrame, rule: InOrder, schema: str, delay: str) -> DataFrame:
    return (
        df.withWatermark("ts", delay)
        .withColumn("us", F.unix_micros("ts"))
        .groupBy(*rule.keys)
        .transformWithStateInPandas(rule, outputStructType=schema, outputMode="Append", timeMode="EventTime")
    )


def _times(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumn(n.replace("_us", "_ts") if n != "us" else "ts", F.timestamp_micros(n)).drop(n)
    return df


def burst_changes(
    frames: DataFrame, p: PerceptionParams, delay: str = "10 seconds", idle_s: float | None = None
) -> DataFrame:
    """Starts and ends of bursts of a stream of frames (camera, ts, frame_idx, live, presence, motion, objects).

    A start has neither ``close_ts`` nor ``flushed``.  With ``idle_s``, a burst still open when its camera has had no frame for that
    long is flushed once the watermark is past that time: other cameras move it, the camera itself needs no later row.  What then
    comes from the camera begins anew.
    """
    flat = frames.withColumn("objects", F.array_join("objects", "/")).select(
        "camera", "ts", "frame_idx", "live", "presence", "motion", "objects")
    out = _run(
        flat, Bursts(p, idle_s),
        "camera string, start_us long, last_live_us long, close_us long, peak_motion double, objects string, live_frames long, "
        "first_motion double, first_objects string, last_row_us long, flushed boolean", delay)
    return _times(out, "start_us", "last_live_us", "close_us", "last_row_us")


def burst_stream(
    frames: DataFrame, p: PerceptionParams, delay: str = "10 seconds", idle_s: float | None = None
) -> DataFrame:
    """Ended bursts of a stream of frames: closed, or flushed after ``idle_s`` of silence."""
    ended = F.col("close_ts").isNotNull() | F.col("flushed")
    return burst_changes(frames, p, delay, idle_s).where(ended).drop("first_motion", "first_objects", "last_row_ts")


def burst_line_stream(
    frames: DataFrame, p: PerceptionParams, delay: str = "10 seconds", idle_s: float | None = None
) -> DataFrame:
    """Event lines of a stream's bursts: burst.start at once, motion.summary and burst.end when a long enough one closes or is flushed."""
    names = lambda c: F.array_sort(F.filter(F.split(c, "/"), lambda x: x != ""))
    padded = F.unix_micros(add_seconds(F.col("last_live_ts"), p.clip_post_s)) - F.unix_micros(
        add_seconds(F.col("start_ts"), -p.clip_pre_s))
    b = burst_changes(frames, p, delay, idle_s).withColumns({
        "objects": names("objects"), "first_objects": names("first_objects"),
        "duration_s": F.greatest(F.lit(0.0), padded / F.lit(1e6)),
    })
    ended = F.col("close_ts").isNotNull() | F.col("flushed")
    b = b.withColumn("kept", ended & (F.col("duration_s") >= p.min_event_sec))
    return perception_events.burst_events(b, p, starts=~ended)


def track_stream(dets: DataFrame, p: PerceptionParams, delay: str = "10 seconds") -> DataFrame:
    """Detections of a stream with the birth of their track and match number."""
    c = [F.col("det_idx").cast("long").alias("det_idx"), "x1", "y1", "x2", "y2"]
    out = _run(
        dets.select("camera", F.col("cls").alias("label"), "ts", "frame_idx", *c), Tracks(p),
        "camera string, label string, us long, frame_idx long, det_idx long, birth_us long, birth_frame long, "
        "birth_det long, match_no long", delay)
    return _times(out.withColumnRenamed("label", "cls"), "us", "birth_us")


def novelty_stream(frames: DataFrame, p: PerceptionParams, delay: str = "10 seconds") -> DataFrame:
    """Frames of a stream with hash distance and novelty."""
    out = _run(
        frames.select("camera", "ts", "frame_idx", "phash"), Novelty(p),
        "camera string, us long, frame_idx long, hash_distance int, novelty string", delay)
    return _times(out, "us")
