"""Trailing-window operators: novelty of a hash and the bounded frame buffer.

A (camera, block) is read once, in time order, with copies of the rows that its first rows look back to.  What a task holds is the
window's times, hashes or sums in numpy arrays, whatever the block's length: no row carries a list of its window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.operators import blocks
from eventide.operators.blocks import BLOCK, CORE
from eventide.params import PerceptionParams

KEYS = ["camera"]
TILE = 2048  # rows compared with each other at a time


def _look_back(
    frames: DataFrame, block_s: float, seconds: float, value: str, made: Callable, out: list[T.StructField]
) -> DataFrame:
    """``frames`` with the columns ``out`` that ``made()`` gives for rows in order.

    ``made()`` is called for each (camera, block) and returns a function of (times, frame numbers, values, which values are
    known); it is called with one run of rows after the other and gives one Arrow array for each new column.
    """
    b = blocks.halo(frames, block_s, seconds).withColumns({
        "_us": F.unix_micros("ts"), "_group": F.xxhash64(*KEYS, BLOCK), "_value": F.col(value).cast("long"),
        "_idx": F.col("frame_idx").cast("long"),
    })
    ordered = b.repartition(*KEYS, BLOCK).sortWithinPartitions(*KEYS, BLOCK, "_us", "_idx")
    schema = T.StructType([*frames.schema.fields, *out])
    kept = frames.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, take = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda n: batch.column(batch.schema.get_field_index(n))  # noqa: B023, E731
            key = column("_group").to_numpy()
            us, idx, raw = column("_us").to_numpy(), column("_idx").to_numpy(), column("_value")
            values, known = pc.fill_null(raw, 0).to_numpy(), pc.is_valid(raw).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            parts = []
            for i, j in zip(edges, edges[1:]):
                if key[i] != group:
                    group, take = key[i], made()
                parts.append(take(us[i:j], idx[i:j], values[i:j], known[i:j]))
            new = [pa.concat_arrays(list(c)) for c in zip(*parts)]
            table = pa.RecordBatch.from_arrays([*map(column, kept), *new], [*kept, *(f.name for f in out)])
            yield table.filter(column(CORE))

    return ordered.mapInArrow(run, schema)


def nearest_before(window_us: int) -> Callable:
    """Least Hamming distance to the hashes of strictly earlier rows of the window; null without any."""
    held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)]

    def take(us, idx, values, known):
        u, i, h, ok = (np.concatenate([a, b]) for a, b in zip(held, (us, idx, values.view(np.uint64), known)))
        n0, n = len(held[0]), len(u)
        low = np.searchsorted(u, us - window_us, "left")
        again = np.concatenate([[False], (u[1:] == u[:-1]) & (i[1:] == i[:-1])])
        high = np.maximum.accumulate(np.where(again, 0, np.arange(n)))[n0:]  # rows before it are strictly earlier
        best = np.full(len(us), 255, np.uint8)
        for a in range(0, len(us), TILE):
            z = min(a + TILE, len(us))
            for c in range(int(low[a]), int(high[z - 1]), TILE):
                d = min(c + TILE, int(high[z - 1]))
                far = np.bitwise_count(h[n0 + a : n0 + z, None] ^ h[None, c:d])
                at = np.arange(c, d)
                far[(at < low[a:z, None]) | (at >= high[a:z, None]) | ~ok[None, c:d]] = 255
                np.minimum(best[a:z], far.min(axis=1), out=best[a:z])
        best[~known] = 255
        keep = int(np.searchsorted(u, us[-1] - window_us, "left"))
        held[:] = [x[keep:] for x in (u, i, h, ok)]
        return (pa.array(best.astype(np.int32), mask=best == 255),)

    return take


def novelty(frames: DataFrame, p: PerceptionParams) -> DataFrame:
    """Adds ``hash_distance`` and ``novelty`` (new / duplicate).

    The distance is the least one to any earlier frame not older than the
    window; without such a frame it is NULL and the frame is new.
    """
    window = blocks.micros(p.novelty_window_s)
    out = [T.StructField("hash_distance", T.IntegerType())]
    found = _look_back(frames, p.block_s, p.novelty_window_s, "phash", lambda: nearest_before(window), out)
    return found.withColumn("novelty", F.when(F.col("hash_distance") <= p.phash_distance_max, "duplicate").otherwise("new"))


def buffered(window_us: int, most: int) -> Callable:
    """Frames held, their bytes, and the oldest one's time: two bisections on times and running sums."""
    held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)]

    def take(us, idx, values, known):
        u, size, ok = (np.concatenate([a, b]) for a, b in zip(held, (us, values, known)))
        n0, n = len(held[0]), len(u)
        upto = np.cumsum(size)
        below, row = upto - size, np.arange(n0, n)
        first = np.maximum(np.searchsorted(u, us - window_us, "left"), np.searchsorted(below, upto[n0:] - most, "left"))
        first = np.minimum(first, row + 1)
        count = np.concatenate([[0], np.cumsum(ok)])
        frames = count[row + 1] - count[first]
        following = np.minimum.accumulate(np.where(ok, np.arange(n), n)[::-1])[::-1]  # next frame of a known size
        oldest = np.append(following, n)[first]
        none = frames == 0
        safe = np.where(none, 0, oldest)
        total = np.where(none, 0, upto[n0:] - below[safe])
        keep = int(np.searchsorted(u, us[-1] - window_us, "left"))
        held[:] = [x[keep:] for x in (u, size, ok)]
        times = pa.array(u[safe], pa.timestamp("us", "UTC"), mask=none)
        return pa.array(frames.astype(np.int32)), pa.array(total), times

    return take


def buffer_state(frames: DataFrame, p: PerceptionParams, size: str = "bytes") -> DataFrame:
    """Adds what a trailing frame buffer holds after each frame.

    Kept are the newest frames not older than ``buffer_s`` whose sizes add up to at most ``buffer_bytes``:
    ``held_frames``, ``held_bytes``, ``oldest_ts``.  Sizes are not negative; a frame without one is never held.
    """
    window, most = blocks.micros(p.buffer_s), p.buffer_bytes
    out = [T.StructField("held_frames", T.IntegerType()), T.StructField("held_bytes", T.LongType()),
           T.StructField("oldest_ts", T.TimestampType())]
    return _look_back(frames, p.block_s, p.buffer_s, size, lambda: buffered(window, most), out)
