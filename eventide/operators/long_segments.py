"""Track matching for stretches without a pause, in parallel and exactly.

Such a stretch is a chain: where a block begins depends on the tracks live at
the end of the block before.  But what matters of a live track for matching is
only its last detection, and that soon no longer depends on how the block was
entered.  So:

1. every block is matched as if nothing was live before it;
2. each block whose true entry, the end of its predecessor, differs from the
   entry it was matched with is matched again; repeated until none differs.
   A chain of equal entries from the first block on proves the result exact.
   Two rounds are usual; every round settles at least one more block;
3. with the settled entries every detection gets its track within the block,
   and a pass over one row per (block, track) links tracks across blocks.

Entries are compared in order: which of two equally near tracks came first
decides a match, in this block or in a later one that the order is handed to.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.operators import blocks
from eventide.operators.batches import starts, whole_groups
from eventide.operators.blocks import BLOCK
from eventide.operators.tracks import SCOPE, SEGMENT, FrameMatcher
from eventide.params import PerceptionParams
from eventide.session import stage

CHUNK = [*SCOPE, SEGMENT, BLOCK]
BOX = ["x1", "y1", "x2", "y2"]
DET = ["_us", "frame_idx", "det_idx"]
_CHUNK_DDL = f"camera string, cls string, {SEGMENT} long, {BLOCK} long"
_ENDS = f"{_CHUNK_DDL}, _us long, frame_idx long, det_idx int, x1 double, y1 double, x2 double, y2 double, pos int"
_ROOTED = f"{_CHUNK_DDL}, _us long, frame_idx long, det_idx int, r_us long, r_frame long, r_det int, seeded boolean, n int"
_LINKED = f"{_CHUNK_DDL}, r_frame long, r_det int, birth_us long, birth_frame long, birth_det int, before int"


def _walk(p: PerceptionParams, final: bool):
    """Task function over chunks sorted as entry tracks, then rows: their ends, or each row's track."""
    iou_threshold, ttl = p.iou_threshold, blocks.micros(p.track_ttl_s)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, m = None, None

        def ends() -> list[tuple]:
            return [(*chunk, *t["last"], *t["box"], i) for i, t in enumerate(m.live)]

        for pdf, groups in whole_groups(batches, [*CHUNK, "_row", "_us", "frame_idx"]):
            keys = list(zip(*(pdf[c] for c in CHUNK)))
            dets = list(zip(*(pdf[c].tolist() for c in DET)))
            boxes = list(zip(*(pdf[c].tolist() for c in BOX)))
            is_row, new_chunk, out = pdf["_row"].tolist(), set(starts(pdf, CHUNK).tolist()), []
            for i, j in zip(groups, [*groups[1:], len(pdf)]):
                if i in new_chunk and keys[i] != chunk:
                    if chunk is not None and not final:
                        out += ends()
                    chunk, m = keys[i], FrameMatcher(iou_threshold, ttl)
                if not is_row[i]:
                    m.live += [
                        {"box": boxes[k], "us": dets[k][0], "n": 0, "birth": dets[k], "last": dets[k], "seed": True}
                        for k in range(i, j)
                    ]
                    continue
                found = m.frame(dets[i][0], boxes[i:j], dets[i:j])
                if final:
                    out += [(*chunk, *d, *t["birth"], "seed" in t, t["n"]) for d, t in zip(dets[i:j], found)]
            if out:
                yield pd.DataFrame(out, columns=names)
        if chunk is not None and not final:
            yield pd.DataFrame(ends(), columns=names)

    names = [part.split()[0] for part in (_ROOTED if final else _ENDS).split(", ")]
    return run


def _run(rows: DataFrame, seeds: DataFrame | None, p: PerceptionParams, final: bool) -> DataFrame:
    cols = [*CHUNK, *DET, *BOX]
    both = rows.select(*cols, F.lit(0).alias("pos"), F.lit(1).alias("_row"))
    if seeds is not None:
        both = both.unionByName(seeds.select(*cols, "pos", F.lit(0).alias("_row")))
    # entry tracks keep their order; rows go by time
    ordered = both.repartition(*CHUNK).sortWithinPartitions(*CHUNK, "_row", "pos", *DET)
    return ordered.mapInPandas(_walk(p, final), _ROOTED if final else _ENDS)


def _entries(chunks: DataFrame, ends: DataFrame) -> DataFrame:
    """Tracks live at the end of each chunk's predecessor, as the chunk's entry."""
    prev = ends.withColumnRenamed(BLOCK, "_prev")
    return chunks.where(F.col("_prev").isNotNull()).join(prev, [*SCOPE, SEGMENT, "_prev"]).drop("_prev")


def _signature(seeds: DataFrame) -> DataFrame:
    """Entry of a chunk as one array; its length is the number of live tracks."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "frame_idx", "det_idx")))
    return seeds.groupBy(*CHUNK).agg(listed.alias("_sig"))


def _settle(rows: DataFrame, chunks: DataFrame, p: PerceptionParams) -> DataFrame:
    """Entries of all chunks, once matching with them reproduces them."""
    ends = stage(_run(rows, None, p, final=False))
    used = rows.sparkSession.createDataFrame([], _signature(_entries(chunks, ends)).schema)
    while True:
        seeds = stage(_entries(chunks, ends))
        now = stage(_signature(seeds))
        both = now.join(used.withColumnRenamed("_sig", "_old"), CHUNK, "full_outer")
        none = F.array().cast(now.schema["_sig"].dataType)
        a, b = F.coalesce("_sig", none), F.coalesce("_old", none)
        changed = stage(both.where(a != b).select(*CHUNK))
        if changed.isEmpty():
            return seeds
        again = _run(rows.join(changed, CHUNK, "left_semi"), seeds.join(changed, CHUNK, "left_semi"), p, final=False)
        ends = stage(ends.join(changed, CHUNK, "left_anti").unionByName(again))
        used = now


def _link(batches: Iterator[pd.DataFrame], ttl: int, size: int) -> Iterator[pd.DataFrame]:
    """Pieces of tracks in block order to their births; remembers tracks young enough to go on."""
    scope, block, known = None, None, {}
    names = [part.split()[0] for part in _LINKED.split(", ")]
    for pdf in batches:
        out = []
        for *key, r_us, r_frame, r_det, seeded, n, last_us, last_frame, last_det in pdf.itertuples(index=False, name=None):
            if key[:3] != scope:
                scope, known = key[:3], {}
            if key[3] != block:
                block = key[3]
                known = {k: v for k, v in known.items() if v[0] >= block * size - ttl}
            birth, before = (r_us, r_frame, r_det), 0
            if seeded:
                _, birth, before = known[(r_frame, r_det)]
            known[(last_frame, last_det)] = (last_us, birth, before + n)
            out.append((*key, r_frame, r_det, *birth, before))
        yield pd.DataFrame(out, columns=names)


def match(rows: DataFrame, p: PerceptionParams) -> DataFrame:
    """As ``tracks.match_detections``, for rows (with block and segment) of long segments."""
    rows = stage(rows)
    order = Window.partitionBy(*SCOPE, SEGMENT).orderBy(BLOCK)
    chunks = stage(rows.select(*CHUNK).distinct().withColumn("_prev", F.lag(BLOCK).over(order)))
    rooted = stage(_run(rows, _settle(rows, chunks, p), p, final=True))

    piece = [*CHUNK, "r_us", "r_frame", "r_det", "seeded"]
    last = F.max_by(F.struct(*DET), "n")
    pieces = rooted.groupBy(*piece).agg(F.max("n").alias("n"), last.alias("_l")).select(*piece, "n", "_l.*")
    ttl, size = blocks.micros(p.track_ttl_s), blocks.micros(p.block_s)
    linked = pieces.repartition(*SCOPE, SEGMENT).sortWithinPartitions(*CHUNK).mapInPandas(
        lambda batches: _link(batches, ttl, size), _LINKED
    )
    found = rooted.join(linked, [*CHUNK, "r_frame", "r_det"]).select(
        *CHUNK, "frame_idx", "det_idx", F.timestamp_micros("birth_us").alias("birth_ts"), "birth_frame", "birth_det",
        (F.col("n") + F.col("before")).cast("int").alias("match_no"),
    )
    return rows.join(found, [*CHUNK, "frame_idx", "det_idx"])
