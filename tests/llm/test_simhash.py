import random

import numpy as np
import pytest
import xxhash

from eventide.llm import simhash as S
from eventide.llm.common import read
from eventide.llm.queries import QUERIES


def brute(rows, radius=3, shingle=3):
    """Fingerprints bit by bit, components by plain search over all pairs."""
    def fp(text):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sh = [b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
        h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    fps = [fp(t) for _, t in rows]
    arr = np.array(fps, np.uint64)
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= radius):
            a, b = find(i), find(int(j))
            comp[max(a, b)] = min(a, b)
    roots = [find(i) for i in range(len(rows))]
    least = {}
    for (d, _), r in zip(rows, roots, strict=True):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted(((d, f"{f:016x}", least.get(r)) for (d, _), f, r in zip(rows, fps, roots, strict=True)), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_every_pair_within_the_radius_meets(radius):
    masks, r = S.covering_masks(radius), random.Random(radius)
    for _ in range(3000):
        diff = sum(1 << b for b in r.sample(range(64), r.randint(0, radius)))
        assert any(not diff & m for m in masks)
        mask = next(m for m in masks if not diff & m)
        assert any(not diff & m for m in S.split_masks(mask, radius))
    assert all(64 - m.bit_count() <= 12 for m in S.split_masks(masks[0], radius)) or radius != 3


def test_forest_joins_what_pairs_join():
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(20)]
    v = np.array([b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base for _ in range(9)], np.uint64)
    edges = S.forest(v, 3)
    assert all(a != b for a, b in edges) and len(edges) <= len(v)


def test_edge_cases(spark):
    rows = [(1, "a b c d"), (2, "A  b\tC d"), (3, None), (4, ""), (5, "x"), (5, "x"), (None, "x"), (7, " \n"), (8, "é É")]
    df = spark.createDataFrame([(d, t, "z", 1) for d, t in rows], "doc_id long, text string, fp string, component_id int")
    assert got(S.near_duplicates(df)) == brute(rows)
    assert got(S.near_duplicates(df.where("doc_id < 0"))) == []


@pytest.mark.parametrize("group", [4096, 3])
def test_against_brute_force(spark, group):
    """With tiny groups every table goes through the second set of masks."""
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for d in range(160):
        if d % 3 and rows:
            w = rows[r.randrange(len(rows))][1].split()
            if w and d % 2:
                w[r.randrange(len(w))] = r.choice(vocab)
        else:
            w = r.choices(vocab, k=r.choice([2, 60, 150]))
        rows.append((d * 7 % 160, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(S.near_duplicates(df, group=group)) == brute(rows)


def test_query(spark, sf):
    rows = [tuple(r) for r in read(spark, sf, "documents").select("doc_id", "text").collect()]
    assert got(QUERIES["op3_simhash"](spark, sf)) == brute(rows)
