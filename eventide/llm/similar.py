"""Links between texts whose sets of word shingles are similar, to go with the fingerprints of :mod:`simhash`.

Each text keeps the least shingle hash in each of 64 classes; bands of four of them are fingerprints of a part of the text.
Texts that meet in a band are compared by their whole sets wherever the sizes of these allow the similarity asked for, in
groups of any size; a smaller group gives all its links, a larger one those that connect it as all would.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from eventide.llm.common import annotate, answered, stage, words
from eventide.operators.components import components

CLASSES, WIDTH = 64, 4
GROUP = 64
CELL_ROWS, CELL_SHINGLES = 1024, 1 << 21  # texts and shingles that a part of a larger group has, about
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of ``size`` words (fewer words: the whole sequence)."""
    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    known: dict[bytes, int] = {}
    ids = [known.setdefault(x, len(known)) for x in w]
    h = np.array([xxhash.xxh3_64_intdigest(x) for x in known], np.uint64)[ids]
    n = max(len(h) - size + 1, 1)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for k in range(min(size, len(h))):
            out = (out ^ h[k : k + n]) * _ODD
            out ^= out >> np.uint64(29)
        return np.unique(out * _ODD)


def least_of_classes(s: np.ndarray) -> np.ndarray:
    """The least hash of each class; an empty class takes the next one's."""
    out = np.full(CLASSES, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(out, (s % np.uint64(CLASSES)).astype(np.int64), s)
    full = np.flatnonzero(out != np.iinfo(np.uint64).max)
    if len(full):
        out = out[full[np.searchsorted(full, np.arange(CLASSES)) % len(full)]]
    return out


def cell_links(
    ids: np.ndarray, roots: np.ndarray, parts: np.ndarray, shingles: np.ndarray, sizes: np.ndarray, similarity: float
) -> list[tuple[int, int]]:
    """Pairs that join what of ``roots`` belongs together by whole sets; ``shingles`` has the sets one after the other.

    With two parts only texts of different parts are compared.  The text with the most common shingles goes first, as the
    original of many copies has them; then every text outside the largest component meets all that it isn't joined with.
    """
    ends = np.cumsum(sizes)
    starts = ends - sizes
    kinds, flat = np.unique(shingles, return_inverse=True)
    comp = np.unique(roots, return_inverse=True)[1]
    common = np.add.reduceat(np.bincount(flat)[flat], starts) / sizes
    mark, out, two = np.zeros(len(kinds), bool), [], len(np.unique(parts)) > 1

    def meet(p: int) -> None:
        far = comp != comp[p]
        if two:
            far &= parts != parts[p]
        if not far.any():
            return
        mark[flat[starts[p] : ends[p]]] = True
        shared = np.add.reduceat(mark[flat], starts, dtype=np.int64)
        mark[flat[starts[p] : ends[p]]] = False
        for q in np.flatnonzero(far & (shared >= similarity * (sizes + sizes[p] - shared))).tolist():
            if comp[q] != comp[p]:
                out.append((min(ids[p], ids[q]), max(ids[p], ids[q])))
                comp[comp == comp[q]] = comp[p]

    meet(int(common.argmax()))
    for p in np.flatnonzero(comp != np.bincount(comp).argmax()).tolist():
        meet(p)
    return out


def _joined(large: DataFrame, sets: DataFrame, sure: DataFrame, similarity: float) -> DataFrame:
    """``sure`` and the pairs that join what it leaves apart in groups ``large`` (band, k1, id, n) of any size.

    Groups that are one component are done.  Of the others those of the fullest band go first, as their links may settle
    the rest, which go together: each round costs the driver some memory, so there are two at most.  A group is dealt into parts of bounded size, each two of which meet in one task, so no task holds an unbounded group
    and no pair of texts in different components goes uncompared; a task gives a forest, not its pairs.
    """
    c = F.col
    group, schema = ["band", "k1"], StructType.fromDDL("a long, b long")
    for turn in range(2):
        roots = components(sure).withColumnsRenamed({"a": "id", "b": "root"})
        rooted = large.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        parts = F.greatest(F.ceil(F.count("*") / F.lit(CELL_ROWS)), F.ceil(F.sum("n") / F.lit(CELL_SHINGLES))).cast("int")
        apart = rooted.groupBy(*group).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), parts.alias("parts"))
        rooted = stage(rooted.join(apart.where("lo != hi").drop("lo", "hi"), group))
        first = rooted.groupBy("band").count().orderBy(F.desc("count"), "band").first()  # one row of 16
        if first is None:
            return sure
        here = (rooted if turn else rooted.where(c("band") == first.band)).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
        here = here.withColumn("other", F.explode(F.sequence(F.lit(0), c("parts") - 1)))
        here = here.select(*group, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "root", "id")

        def run(t: pa.Table) -> pa.Table:
            s = t.column("s").combine_chunks()
            one = lambda x: t.column(x).to_numpy()
            pairs = cell_links(one("id"), one("root"), one("part"), s.flatten().to_numpy(), s.value_lengths().to_numpy().astype(np.int64), similarity)
            a = np.array(pairs, np.int64).reshape(-1, 2)
            return pa.table([a[:, 0], a[:, 1]], schema=to_arrow_schema(schema))

        sure = stage(sure.unionByName(here.join(sets, "id").groupBy(*group, "i", "j").applyInArrow(run, schema)))
        large = rooted.where(c("band") != first.band).select(*group, "id", "n")
    return sure


def similar_pairs(
    docs: DataFrame, id_col: str, text_col: str, size: int = 5, similarity: float = 0.8, group: int = GROUP, in_blocks: bool = False
) -> DataFrame:
    """Pairs (a, b) of ids whose shingle sets have a Jaccard similarity of ``similarity`` or more.

    Texts with equal sets are folded first and stand for each other by a pair with the least of their ids.  Groups that
    meet in a band are compared all with all up to ``group`` texts.  In larger ones all are compared with the least id, then
    what is still apart is joined by whole sets (:func:`_joined`): pairs that connect the group as all its pairs would.  Rows
    with a null id are left out.
    With ``in_blocks``, docs is a :func:`common.blocked` table and the texts to compare are taken from their blocks, so that
    no text is shuffled.
    """
    c = F.col
    place = [c("block")] if in_blocks else []
    rows = docs.where(c(id_col).isNotNull()).select(c(id_col).cast("bigint").alias("id"), *place, c(text_col).alias("text"))

    def sketch(texts: list[str | None]) -> list[list]:
        sets = [shingle_set(t, size) for t in texts]
        least = [least_of_classes(s) for s in sets]
        return [[xxhash.xxh3_64_intdigest(s.tobytes()) >> 1 for s in sets], [len(s) for s in sets],
                [(x.view(np.int64) if len(s) else np.empty(0, np.int64)).tolist() for x, s in zip(least, sets, strict=True)]]

    told = stage(annotate(rows, "text", "whole long, n long, least array<bigint>", sketch))
    first = told.where("n > 0").groupBy("whole").agg(F.min("id").alias("id"), F.any_value("least").alias("least"), F.any_value("n").alias("n"))
    first = stage(first)
    copies = told.where("n > 0").select("whole", c("id").alias("b")).join(first.select("whole", c("id").alias("a")), "whole")
    copies = copies.where("a != b").select("a", "b")
    bands = CLASSES // WIDTH
    met = first.select("id", "n", F.explode(F.array(*[
        F.struct(F.lit(k).alias("band"), F.xxhash64(F.slice("least", k * WIDTH + 1, WIDTH)).alias("k1")) for k in range(bands)
    ])).alias("x")).select("id", "n", "x.*")
    alone = Window.partitionBy("band", "k1")
    met = stage(met.withColumn("n1", F.count("*").over(alone)).withColumn("a", F.min("id").over(alone)).where("n1 > 1"))
    large = met.where(c("n1") > group)
    star = large.where("a != id").select("a", c("id").alias("b"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for ms in b["ms"]:
                ids = [m["id"] for m in ms]
                n = [m["n"] for m in ms]
                out += [(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in combinations(range(len(ids)), 2)
                        if min(n[i], n[j]) >= similarity * max(n[i], n[j])]
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    few = met.where(c("n1") <= group).groupBy("band", "k1").agg(
        F.collect_list(F.struct("id", "n")).alias("ms")).where("size(ms) > 1")
    close = few.select("ms").mapInPandas(compare, "a long, b long")
    asked = stage(close.unionByName(star).distinct())
    needed = asked.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    whole = lambda texts: [[shingle_set(t, size).view(np.int64).tolist() for t in texts]]
    if in_blocks:
        schema = StructType.fromDDL("id long, s array<bigint>")

        def take(block: pa.Table, asked_: pa.Table) -> pa.Table:
            block = block.filter(pc.is_in(block.column("id"), asked_.column("id").combine_chunks()))
            s = whole(block.column("text").to_pylist())[0]
            return pa.table([block.column("id"), pa.array(s, pa.list_(pa.int64()))], schema=to_arrow_schema(schema))

        asked_of = told.select("id", "block").join(needed, "id", "left_semi").select("block", "id")
        sets = stage(answered(docs, asked_of, take, schema).dropDuplicates(["id"]))
    else:
        sets = stage(annotate(rows.join(needed, "id", "left_semi"), "text", "s array<bigint>", whole).dropDuplicates(["id"]))
    both = asked.join(sets.withColumnsRenamed({"id": "a", "s": "sa"}), "a").join(sets.withColumnsRenamed({"id": "b", "s": "sb"}), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    sure = both.where(shared >= similarity * (F.size("sa") + F.size("sb") - shared)).select("a", "b")
    if not large.isEmpty():
        sure = _joined(large.select("band", "k1", "id", "n"), sets, stage(sure), similarity)
    return sure.unionByName(copies)
