"""Sketches, shifts and near-identical captions against plain Python."""

import random
from bisect import bisect_right

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.operators import near_blocks
from eventide.operators import near_text as N
from eventide.operators.components import components
from eventide.params import TrendParams
from eventide.plans import shifts as S


def ks(a, b):
    a, b = sorted(a), sorted(b)
    return max(abs(bisect_right(a, x) / len(a) - bisect_right(b, x) / len(b)) for x in [*a, *b])


@pytest.mark.parametrize("k,n", [(4096, 300), (200, 20_000)])
def test_distance_is_within_its_bound(spark, k, n):
    """Exact but for the grid while a sketch holds all values; within the sketch's rank error beyond."""
    r = random.Random(k)
    days = {d: [r.gauss(0, 1) + (0.6 if d >= 6 else 0) for _ in range(n if d != 3 else n // 10)] for d in range(8)}
    rows = [("c", d, x) for d, v in days.items() for x in v] + [("c", 2, None)]
    df = spark.createDataFrame(rows, "camera string, day long, value double").repartition(7)
    p = TrendParams(baseline_days=4, min_days=2, shift_threshold=0.15)
    got = {x.day: x for x in S.value_shift(df, "day", p, ["camera"], k=k).collect()}
    assert set(got) == set(days) and got[0].distance is None and got[1].shift is None
    for d in range(2, 8):
        base = [x for e in range(max(0, d - 4), d) for x in days[e]]
        error = 1 / S.GRID + (0 if len(base) <= k else 2 * 0.0133)
        assert abs(got[d].distance - ks(days[d], base)) <= error + 1e-9
        assert (got[d].n, got[d].base_n, got[d].base_periods) == (len(days[d]), len(base), min(d, 4))
    assert [d for d in got if got[d].shift] == [6, 7]


def test_stale_sources(spark):
    rows = [("a", 1), ("b", 1), ("a", 2), ("a", 3), ("b", 9), (None, 9), ("a", 30)]
    g = spark.createDataFrame([(s, f"2024-01-{d:02} 05:00:00") for s, d in rows], "source string, hour string")
    got = S.stale_sources(g.withColumn("hour", F.to_timestamp("hour")), TrendParams(baseline_days=7)).collect()
    assert {x.date.day: (x.known_sources, x.stale_sources) for x in got} == {1: (2, 0), 2: (2, 1), 3: (2, 1), 9: (2, 1), 30: (1, 0)}


def groups(rows, threshold):
    sets = {i: frozenset(t.lower().split()) for i, t in rows if i is not None and t is not None}
    at = {i: i for i in sets}
    near = lambda a, b: a == b or (len(a & b) / len(a | b) >= threshold if a and b else False)
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if at[a] != at[b] and near(sets[a], sets[b]):
                lo, hi = sorted((at[a], at[b]))
                at = {k: lo if v == hi else v for k, v in at.items()}
    return at


@pytest.mark.parametrize("threshold,paired", [(0.8, 64), (0.8, 1), (0.6, 1)])
def test_groups_against_all_pairs(spark, threshold, paired):
    """With ``paired`` 1 every band counts as hot, so that prefixes find what the pivot doesn't."""
    r = random.Random(paired)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, k = [], 0
    for _ in range(40):
        base = r.sample(vocabulary, r.randint(4, 14))
        for _ in range(r.randint(1, 6)):
            w = list(base)
            if r.random() < 0.7:
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((k := k + 1, " ".join(r.sample(w, len(w)))))
    rows += [(900, ""), (901, " "), (902, None), (None, rows[0][1]), (903, rows[3][1].upper()), (904, rows[3][1] + " " + rows[3][1])]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("words", F.lit(1)).withColumn("group", F.lit(2))
    got = {x.id: x["group"] for x in N.near_groups(df, threshold, paired=paired).collect()}
    assert got == groups(rows, threshold)
    assert N.near_groups(df.limit(0), threshold).count() == 0


def test_measured_recall(spark):
    """Pairs right at the threshold, which bands miss most easily: at least 0.99 found."""
    r = random.Random(5)
    rows = []
    for k in range(600):
        same = [f"p{k}_{i}" for i in range(8)]
        rows += [(2 * k, " ".join([*same, f"a{k}"])), (2 * k + 1, " ".join([*same, f"b{k}"]))]  # 8 of 10 words
    r.shuffle(rows)
    got = N.near_groups(spark.createDataFrame(rows, "id long, text string"), 0.8).collect()
    assert sum(x.id % 2 == 1 and x["group"] == x.id - 1 for x in got) >= 594
    assert {N.bands(t)[0] * N.bands(t)[1] <= 128 for t in (0.2, 0.5, 0.8, 0.95, 1.0)} == {True}


def test_a_band_that_all_captions_share(spark):
    """2,000 different captions that begin alike: the pivot and prefixes keep the pairs looked at in proportion to the captions."""
    phrase = " ".join(f"common{i}" for i in range(30))
    rows = [(k, f"{phrase} only{k} also{k % 50}") for k in range(2000)] + [(5000 + k, f"rare{k} thing{k} seen{k} here{k}") for k in range(50)]
    sets = spark.createDataFrame(rows, "id long, text string").select("id", N.word_set(F.col("text")).alias("words"))
    links = N.near_links(sets, 0.8)
    assert links.count() <= 20 * len(rows)
    assert {(x.a, x.b) for x in components(links).collect()} == {(k, 0) for k in range(1, 2000)}


def test_low_threshold_misses_no_pair(spark):
    """Pairs right at 0.2, where bands of one hash overlook one in a thousand and select most others: all are found."""
    rows = []
    for k in range(4000):
        mine = lambda s, k=k: " ".join(f"{s}{k}_{i}" for i in range(4))
        rows += [(2 * k, f"p{k} q{k} {mine('a')}"), (2 * k + 1, f"p{k} q{k} {mine('b')}")]  # 2 of 10 words
    got = N.near_groups(spark.createDataFrame(rows, "id long, text string"), 0.2).collect()
    assert sum(x["group"] == x.id - x.id % 2 for x in got) == len(rows)


@pytest.mark.parametrize("threshold,words", [(0.2, 1000), (0.2, 9000), (0.08, 2000)])
def test_blocks_against_all_pairs(spark, threshold, words):
    """Sets of 1 to 40 words with frequent ones among them, and a group of near copies, in several blocks or one."""
    r = random.Random(words)
    often, rare = [f"o{k}" for k in range(12)], [f"w{k}" for k in range(700)]
    rows = [(k, " ".join(r.sample(often, r.randint(0, 4)) + r.sample(rare, r.randint(1, 36)))) for k in range(150)]
    same = r.sample(rare, 20)
    rows += [(200 + k, " ".join([*same, f"x{k}"])) for k in range(60)] + [(400, "o1"), (401, "o1 o2 o3 o4 o5"), (402, "o6 o7 o8 o9 o10 o0")]
    sets = spark.createDataFrame(rows, "id long, text string").select("id", N.word_set(F.col("text")).alias("words"))
    links = near_blocks.block_links(sets, threshold, words)
    assert links.count() < 10 * len(rows)
    at = {x.a: x.b for x in components(links).collect()}
    assert {k: at.get(k, k) for k, _ in rows} == groups(rows, threshold)


def test_blocks_leave_out_what_is_joined(monkeypatch):
    """Large groups are left out of the index while they grow; the groups found are those of all pairs."""
    monkeypatch.setattr(near_blocks, "LEAST_LEFT_OUT", 4)
    r = random.Random(3)
    sets = [sorted(r.sample(range(b, b + 30), r.randint(3, 14))) for b in (0, 0, 0, 20, 60, 60, 100) for _ in range(30)]
    n = len(sets)
    left, right = np.arange(n) % 2 == 0, np.arange(n) % 3 != 0
    edges = near_blocks.forest(np.arange(n), np.arange(n) // 2 * 2, left, right, np.array([len(s) for s in sets]),
                               np.concatenate([np.array(s, np.int64) for s in sets]), 0.25)
    near = [(x, y) for x in range(n) for y in range(n) if x != y and left[x] and right[y]
            and 4 * len({*sets[x]} & {*sets[y]}) >= len({*sets[x]} | {*sets[y]})]
    known = [(x, x // 2 * 2) for x in range(n)]

    def least(pairs):
        at = list(range(n))
        for a, b in pairs:
            lo, hi = sorted((at[a], at[b]))
            at = [lo if v == hi else v for v in at]
        return at

    assert len(edges) < n and least([*known, *edges]) == least([*known, *near])


def test_an_index_knows_what_two_sets_share():
    """Frequent words as bits and rarer ones over postings: a look-up gives the near sets and exact counts, nothing is left to verify."""
    r = random.Random(7)
    sets = [{*r.sample(range(90), r.randint(0, 25)), *r.sample(range(90, 400), r.randint(1, 12))} for _ in range(300)]
    sizes = np.array([len(s) for s in sets])
    looked = []

    class Index(near_blocks._Index):
        def near(self, words, bits, size, threshold):
            found = super().near(words, bits, size, threshold)
            looked.append(found)
            return found

    ranks = np.concatenate([np.array([*s], np.int64) for s in sets])
    whole, near_blocks._Index = near_blocks._Index, Index
    try:
        near_blocks.forest(np.arange(300), np.arange(300), sizes >= 0, sizes >= 0, sizes, ranks, 0.2)
    finally:
        near_blocks._Index = whole
    order = np.argsort(sizes, kind="stable")
    assert len(looked) == 300
    for x, (y, same) in zip(order.tolist(), looked, strict=True):
        assert [len(sets[x] & sets[k]) for k in y.tolist()] == same.tolist()
        assert {*y.tolist()} == {k for k in range(300) if 5 * len(sets[x] & sets[k]) >= len(sets[x] | sets[k])}


def test_words_that_one_set_has_do_not_travel(spark):
    """They can't be shared, but they count in a set's size."""
    sets = spark.createDataFrame([(1, ["a", "b", "x1"]), (2, ["a", "b", "x2"]), (3, ["b", "x3"]), (4, ["x4"])], "id long, words array<string>")
    got = {x.id: (x.size, len(x.ranks)) for x in near_blocks._numbered(sets).collect()}
    assert got == {1: (3, 2), 2: (3, 2), 3: (2, 1)}
    assert {(x.a, x.b) for x in near_blocks.block_links(sets, 0.3).collect()} == {(2, 1)}
