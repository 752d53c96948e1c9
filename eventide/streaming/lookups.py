"""As-of look-ups on streams (C10, C13): frames and targets of a camera in one state.

A target waits until the frame after it has come, or until the watermark says that none within the longest gap can come any more.  So
results equal the batch operators, and the state holds the last frame and the targets of one gap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.operators import blocks
from eventide.streaming.stateful import InOrder, _run, _times

FRAME, TARGET = 0, 1


class Lookup(InOrder):
    keys = ["camera"]
    columns = ["us", "kind", "number"]  # a frame before a target of equal time
    row_schema = "us long, kind int, number long"
    # the last frame, and targets that wait with the frame before them
    rule_schema = "kind int, us long, number long, prev_us long, prev_number long"
    output = ["number", "at_us", "frame_us", "frame_idx"]

    def __init__(self, gap_s: float):
        self.gap = blocks.micros(gap_s)

    def silence(self, memory):
        return min((m[1] + self.gap for m in memory if m[0] == TARGET), default=None)

    def advance(self, rows, memory, limit):
        last = next(((m[1], m[2]) for m in memory if m[0] == FRAME), None)
        waiting = [m for m in memory if m[0] == TARGET]
        out = []
        for us, kind, number in rows:
            if kind == TARGET:
                waiting.append((TARGET, us, number, *(last or (None, None))))
                continue
            still = []
            for w in waiting:
                if self.answers(us, w[1]):
                    out.append(self.answer(w, (us, number)))
                else:
                    still.append(w)
            waiting = still
            if last is None or us > last[0]:  # of equal times the lowest number counts
                last = (us, number)
        late = [w for w in waiting if w[1] + self.gap < limit]
        out += [self.answer(w, None) for w in late]
        waiting = [w for w in waiting if w[1] + self.gap >= limit]
        return [*([(FRAME, *last, None, None)] if last else []), *waiting], out

    def answers(self, frame_us: int, at: int) -> bool:
        raise NotImplementedError

    def answer(self, target: tuple, frame: tuple[int, int] | None) -> tuple:
        raise NotImplementedError


class Nearest(Lookup):
    """The frame closest in time; of two equally close ones the earlier."""

    def answers(self, frame_us, at):
        return frame_us >= at

    def answer(self, target, frame):
        _, at, number, prev_us, prev_number = target
        near = None if prev_us is None else (prev_us, prev_number)
        if frame is not None and (near is None or at - near[0] > frame[0] - at):
            near = frame
        if near is None or abs(near[0] - at) > self.gap:
            near = (None, None)
        return (number, at, *near)


class Following(Lookup):
    """The first frame strictly after the target."""

    def answers(self, frame_us, at):
        return frame_us > at

    def answer(self, target, frame):
        _, at, number, _, _ = target
        return (number, at, *(frame if frame is not None and frame[0] <= at + self.gap else (None, None)))


def _looked_up(targets: DataFrame, frames: DataFrame, at: str, number: str, rule: Lookup, delay: str) -> DataFrame:
    c = F.col
    rows = frames.select("camera", "ts", F.lit(FRAME).alias("kind"), c("frame_idx").cast("long").alias("number")).unionByName(
        targets.select("camera", c(at).alias("ts"), F.lit(TARGET).alias("kind"), c(number).cast("long").alias("number")))
    out = _run(rows, rule, "camera string, number long, at_us long, frame_us long, frame_idx long", delay)
    return _times(out, "at_us", "frame_us").withColumnRenamed("number", number).withColumnRenamed("at_ts", at)


def nearest_frame_stream(
    targets: DataFrame, frames: DataFrame, at: str, number: str, max_gap_s: float, delay: str = "10 seconds"
) -> DataFrame:
    """Targets (camera, ``number``, ``at``) of a stream with ``frame_ts`` and ``frame_idx`` of the closest frame within ``max_gap_s``, or nulls.

    ``number`` is a whole number that tells a target apart; other columns of targets are left to a join on it.
    """
    return _looked_up(targets, frames, at, number, Nearest(max_gap_s), delay)


def next_frame_stream(
    targets: DataFrame, frames: DataFrame, at: str, number: str, within_s: float, delay: str = "10 seconds"
) -> DataFrame:
    """As :func:`nearest_frame_stream`, with the first frame strictly after ``at``, not later than ``within_s``."""
    return _looked_up(targets, frames, at, number, Following(within_s), delay)
