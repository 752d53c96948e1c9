"""Links of near word sets at low thresholds, exactly: blocks of sets against blocks, one pair of blocks a task.

Where a band of MinHashes is a single hash, bands select most of all pairs and split nothing.  Here each two blocks meet in
one task, which goes through one of them set by set, each against the whole other block at a time.  The 64 words that most of
the block's sets have are bits of one number, rarer words are counted over their postings, so that the number of words in
common with each set of the block is known exactly.

A task gives a spanning forest of its links, not all of them, and does not look inside what is joined already: blocks
are compared with themselves first, and the groups found there go into the comparison of different blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.operators.components import components
from eventide.session import stage

BLOCK_WORDS = 1 << 22  # words of a block's sets; a task holds two blocks
SPREAD, SPREAD_ROWS = 8, 2048  # blocks that smaller tables are dealt into, if these have as many sets each
LEAST_LEFT_OUT = 256  # sets of a group in a block that are worth an index without them
BITS = 64  # words of a block that are bits of a set
_LINKS = "a long, b long"
_EPS = 1e-9


def _numbered(sets: DataFrame) -> DataFrame:
    """(id, size, ranks): of each set its number of words, and those that another set has too, as numbers."""
    words = sets.select("id", F.size("words").alias("size"), F.explode("words").alias("token"))
    often = words.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    number = stage(often.select("token", F.monotonically_increasing_id().alias("at")))
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    parts, rows = (x or 0 for x in number.agg(F.max(part), F.max(row)).first())
    kind = "int" if (parts + 1) * (rows + 1) < 1 << 31 else "long"
    number = number.select("token", (part * (rows + 1) + row).cast(kind).alias("rank"))
    return words.join(number, "token").groupBy("id", "size").agg(F.collect_list("rank").alias("ranks"))


class _Index:
    """Sets by size: their frequent words as bits, and of each rarer word the places of the sets that have it."""

    def __init__(self, place: np.ndarray, sizes: np.ndarray, bits: np.ndarray, word: np.ndarray, owner: np.ndarray, n_words: int):
        """``sizes`` and ``word`` ascend."""
        self.place, self.sizes, self.bits, self.word, self.owner, self.n_words = place, sizes, bits, word, owner, n_words
        self.ends = np.searchsorted(word, np.arange(n_words + 1))
        self.room, self.counts = np.empty(len(place), np.uint64), np.empty(len(place), np.uint8)
        self.size, self.some, self.least = -1, slice(0), sizes

    def without(self, out: np.ndarray) -> _Index:
        """``out``: whether a set is left out."""
        keep, stays = ~out[self.owner], np.cumsum(~out) - 1
        return _Index(self.place[~out], self.sizes[~out], self.bits[~out], self.word[keep], stays[self.owner[keep]], self.n_words)

    def near(self, words: np.ndarray, bits: np.uint64, size: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Sets with enough words in common with a set of ``size`` words to be near it, and how many these are."""
        if size != self.size:
            least = np.ceil(threshold / (1 + threshold) * (size + self.sizes) - _EPS).astype(np.int64)
            can = np.flatnonzero(least <= np.minimum(size, self.sizes))
            self.size, self.some = size, slice(can[0], can[-1] + 1) if len(can) else slice(0)
            self.least = least[self.some]
        found = [self.owner[s:e] for s, e in zip(self.ends[words].tolist(), self.ends[words + 1].tolist(), strict=True)]
        place, n = self.place[self.some], len(self.least)
        same = np.bincount(np.concatenate(found), minlength=len(self.place))[self.some] if found else np.zeros(n, np.int64)
        same += np.bitwise_count(np.bitwise_and(self.bits[self.some], bits, out=self.room[:n]), out=self.counts[:n])
        enough = np.flatnonzero(same >= self.least)
        return place[enough], same[enough]


def _as_bits(column: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Of ``n`` sets the columns they have, as bits."""
    bits = np.zeros(n, np.uint64)
    order = np.argsort(column, kind="stable")
    cuts = np.searchsorted(column[order], np.arange(BITS + 1))
    for k in range(BITS):
        bits[owner[order[cuts[k] : cuts[k + 1]]]] |= np.uint64(1 << k)
    return bits


def forest(ids: np.ndarray, part: np.ndarray, left: np.ndarray, right: np.ndarray, sizes: np.ndarray, ranks: np.ndarray,
           threshold: float, held: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges (place, place) that join, with what ``part`` joins already, all near sets of which one is ``left`` and the other ``right``.

    ``ranks`` has the words of the sets one set after the other, ``held`` of each, or all of its ``sizes``.
    """
    held = sizes if held is None else held
    known = np.unique(ranks)
    word = np.searchsorted(known, ranks).astype(np.int32)
    owner = np.repeat(np.arange(len(ids), dtype=np.int32), held)
    of_right = right[owner]
    often = np.bincount(word[of_right], minlength=len(known))
    column = np.full(len(known), -1, np.int16)
    column[np.argsort(-often, kind="stable")[:BITS]] = np.arange(min(BITS, len(known)))
    is_bit = column[word] >= 0
    bits = _as_bits(column[word[is_bit]], owner[is_bit], len(ids))

    place = np.flatnonzero(right)
    place = place[np.argsort(sizes[place], kind="stable")]
    at_place = np.zeros(len(ids), np.int64)
    at_place[place] = np.arange(len(place))
    rare = of_right & ~is_bit
    order = np.argsort(word[rare], kind="stable")
    index = _Index(place, sizes[place], bits[place], word[rare][order], at_place[owner[rare]][order], len(known))
    del of_right, rare, order, at_place
    mine = left[owner] & ~is_bit & (often[word] > 0)
    ends = np.concatenate(([0], np.cumsum(np.bincount(owner[mine], minlength=len(ids)))))
    word = word[mine]
    del owner, is_bit, mine

    label = np.unique(part, return_inverse=True)[1]
    members = np.split(np.argsort(label, kind="stable"), np.cumsum(np.bincount(label))[:-1])
    inside = np.bincount(label[right], minlength=len(members))  # sets of ``right`` under each label
    large = max(LEAST_LEFT_OUT, len(place) // 4)
    smaller: dict[int, tuple[int, _Index]] = {}  # of large labels the sets left out and the index without them
    edges = []
    probes = np.flatnonzero(left)
    for x in probes[np.argsort(sizes[probes], kind="stable")].tolist():
        at, use, size = int(label[x]), index, int(sizes[x])
        if inside[at] >= large:
            out, use = smaller.get(at, (0, index))
            if inside[at] > 1.5 * out:
                use = index.without(label[place] == at)
                smaller = {k: v for k, v in smaller.items() if inside[k]} | {at: (int(inside[at]), use)}
        y, same = use.near(word[ends[x] : ends[x + 1]], bits[x], size, threshold)
        y = y[(label[y] != at) & (same / (size + sizes[y] - same) >= threshold)]
        if not len(y):
            continue
        others, one = np.unique(label[y], return_index=True)
        edges += [(x, k) for k in y[one].tolist()]
        joined = [at, *others.tolist()]
        to = max(joined, key=lambda k: len(members[k]))
        for k in joined:
            if k != to:
                label[members[k]] = to
        members[to] = np.concatenate([members[k] for k in joined])
        inside[to] = inside[joined].sum()
        for k in joined:
            if k != to:
                members[k], inside[k] = members[k][:0], 0
    return edges


def _task(threshold: float) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        i, j = (k.as_py() for k in key)
        ids, part, block = (rows.column(c).to_numpy() for c in ("id", "part", "block"))
        sizes = rows.column("size").to_numpy().astype(np.int64)
        held = pc.list_value_length(rows.column("ranks")).to_numpy().astype(np.int64)
        ranks = pc.list_flatten(rows.column("ranks")).to_numpy()
        edges = forest(ids, part, block == i, block == j, sizes, ranks, threshold, held)
        a, b = ids[np.array(edges, np.int64).reshape(-1, 2)].T
        return pa.table({"a": pa.array(np.maximum(a, b), pa.int64()), "b": pa.array(np.minimum(a, b), pa.int64())})

    return run


def block_links(sets: DataFrame, threshold: float, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows (a, b), a > b, of near sets that join all that are near, directly or over others.

    ``sets`` has id and words, distinct sets that are not empty.  Every two sets meet in one task: the work grows with the
    square of their number, and a task's memory with ``block_words``.
    """
    c = F.col
    rows, words = sets.agg(F.count("*"), F.sum(F.size("words"))).first()
    blocks = max(1, -(-(words or 0) // block_words), min(SPREAD, rows // SPREAD_ROWS))
    ranked = stage(_numbered(sets).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")))
    run = _task(threshold)

    def compared(met: DataFrame, pairs: int) -> DataFrame:
        return stage(met.repartition(4 * pairs, "i", "j").groupBy("i", "j").applyInArrow(run, _LINKS))

    inner = compared(ranked.select(c("block").alias("i"), c("block").alias("j"), "block", "id", c("id").alias("part"), "size", "ranks"), blocks)
    if blocks == 1:
        return inner
    joined = components(inner).select(c("a").alias("id"), c("b").alias("part"))
    named = ranked.join(joined, "id", "left").withColumn("part", F.coalesce("part", "id"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    met = named.select("*", other).where("block != other")
    met = met.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "part", "size", "ranks")
    return inner.unionByName(compared(met, blocks * (blocks - 1) // 2))
