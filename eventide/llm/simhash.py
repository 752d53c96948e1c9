"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventide.llm.common import annotate, stage, words
from eventide.operators.components import components
from eventide.llm.similar import similar_pairs

BITS = 64
SEED = 42
RADIUS = 3
GROUP = 4096  # fingerprints compared in one task at a time; larger groups are split by further masks


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority of the XXH64 bits of a text's word shingles, as an unsigned number; 0 without words."""
    w = words(text)
    if not w:
        return 0
    line = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(w))
    spans = zip(starts[: len(w) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    h = np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in spans], dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(ones * 2 > len(h)).tolist())


def covering_masks(radius: int) -> list[int]:
    """2^(radius+1) - 1 masks such that any ``radius`` bits lie wholly outside one of them.

    Bit i gets a non-zero vector of radius+1 binary digits, in turn; mask v keeps the bits whose vector has an odd
    inner product with v.  Up to ``radius`` vectors span too few dimensions for none of the v to be orthogonal to all.
    """
    top = 1 << (radius + 1)
    of = [1 + i % (top - 1) for i in range(BITS)]
    return [sum(1 << i for i, p in enumerate(of) if (p & v).bit_count() & 1) for v in range(1, top)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def split_masks(mask: int, radius: int, pieces: int = 10) -> list[int]:
    """Masks for fingerprints that agree under ``mask`` already: all but ``radius`` pieces of the free bits are added.

    Whatever up to ``radius`` free bits differ, one of these leaves them out; a group of distinct fingerprints has at
    most 2 to the number of bits left out.
    """
    free = [i for i in range(BITS) if not mask >> i & 1]
    parts = [free[k::pieces] for k in range(pieces)]
    return [
        mask | sum(1 << i for k in range(pieces) if k not in out for i in parts[k])
        for out in combinations(range(pieces), radius)
    ]


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges (root, member) of the components of ``values`` under Hamming distance; never a list of all pairs."""
    left, edges = np.unique(values), []
    while len(left) > 1:
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= radius
            if near.any():
                found = left[near]
                left = left[~near]
                edges += [(root, x) for x in found]
                queue.extend(found)
    return edges


def _groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with ``n``, the size of its group; groups of one are left out."""
    return df.withColumn("n", F.count("*").over(Window.partitionBy(*keys))).where("n > 1")


def _link(df: DataFrame, keys: list[str], radius: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            edges = [e for x in b["fps"] for e in forest(np.asarray(x, np.int64).view(np.uint64), radius)]
            a = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
            yield pd.DataFrame({"a": a[:, 0], "b": a[:, 1]})

    return df.groupBy(*keys).agg(F.collect_list("fp").alias("fps")).select("fps").mapInPandas(run, "a long, b long")


def links(fps: DataFrame, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``fp`` (long) of ``fps`` as all pairs within ``radius`` would.

    Every pair within the radius meets in some table of :func:`covering_masks`.  A group there larger than ``group`` is
    dealt out again under :func:`split_masks`, whose groups are bounded, so no task holds an unbounded group and no
    link is lost.  Inside a group a spanning forest is emitted, not its pairs.
    """
    masks = covering_masks(radius)
    keyed = fps.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("t", "key")
    )
    met = stage(_groups(keyed, ["t", "key"]))
    small = _link(met.where(F.col("n") <= group), ["t", "key"], radius)
    large = met.where(F.col("n") > group)
    tables = large.select("t").distinct().collect()  # 2^(radius+1)-1 rows at most
    for (t,) in tables:
        subs = split_masks(masks[t], radius)
        sub = large.where(F.col("t") == t).select(
            "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in subs])).alias("s", "key")
        )
        small = small.unionByName(_link(_groups(sub, ["s", "key"]), ["s", "key"], radius))
    return small


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS, group: int = GROUP,
    similarity: float | None = None, size: int = 5, others: tuple[str, ...] = (), in_blocks: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hexadecimal digits), component_id.

    Two documents are linked if their fingerprints differ in ``radius`` bits or fewer; component_id is the smallest
    doc_id reachable.  Null and empty texts have fingerprint zero and are linked like any other; texts with fewer than
    ``shingle`` words hash the whole sequence.  Repeated rows and ids are kept as they are; a null id keeps its row and
    never becomes a component_id unless all of the component are null.  Other columns are ignored.  Equal fingerprints
    are folded into one row before any search, so copies cost nothing there.  Runs jobs when called.

    With ``similarity``, documents are also linked whose sets of ``size``-word shingles are as similar (Jaccard): edits
    that a fingerprint of the whole text moves further than the radius (:mod:`similar`).  ``others`` are columns that the
    result keeps; ``in_blocks`` says that docs is a :func:`common.blocked` table.
    """
    def run(texts: list[str | None]) -> list[np.ndarray]:
        return [np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)]

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), *others, F.col(text_col).alias("text"))
    marked = stage(annotate(rows, "text", "fp long", run))
    unique = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = links(unique.select("fp"), radius, group)
    if similarity is not None:
        fp_of = marked.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("fp"))
        pairs = similar_pairs(docs, id_col, text_col, size, similarity, in_blocks=in_blocks)
        pairs = pairs.join(fp_of.select(F.col("doc_id").alias("a"), F.col("fp").alias("x")), "a")
        pairs = pairs.join(fp_of.select(F.col("doc_id").alias("b"), F.col("fp").alias("y")), "b")
        edges = edges.unionByName(pairs.where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")))
    roots = components(edges)
    rooted = unique.join(roots.withColumnsRenamed({"a": "fp", "b": "root"}), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least"
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(found, "fp").select(
        "doc_id", *others, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
