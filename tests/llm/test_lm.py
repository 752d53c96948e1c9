import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.llm import lm as L
from eventide.llm.common import read
from eventide.llm.queries import QUERIES
from eventide.llm.trie import EliasFano, Trie


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w] + [None]


def brute(rows, train):
    """Base scores, and the bigram model by dictionaries (one shard, no split context)."""
    toks = [tokens(t) for _, t in rows]
    c = Counter(w for x, t in zip(toks, train, strict=True) if t for w in x)
    space = sum(c.values()) + len(c) + 1
    uni = lambda w: (c[w] + 1) / space
    word = lambda w: w if c[w] else "\0unseen"
    pairs = lambda x: list(zip(["\0begin"] + [word(w) for w in x[:-1]], [word(w) for w in x], strict=True))
    big = Counter(p for x, t in zip(toks, train, strict=True) if t for p in pairs(x))
    total, kinds = Counter(), Counter()
    for (u, _), n in big.items():
        total[u] += n
        kinds[u] += 1
    n1, n2 = (sum(n == k for n in big.values()) for k in (1, 2))
    d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    level = lambda u: int(math.log2(total[u]))
    lam = defaultdict(lambda: 0.5)
    for _ in range(4):
        up, all_ = defaultdict(lambda: 1.0), defaultdict(lambda: 2.0)
        for (u, w), n in big.items():
            if total[u] > 1:
                k = kinds[u] if n > 1 else kinds[u] - 1
                p = (max(n - 1 - d, 0) + d * k * uni(w)) / (total[u] - 1)
            else:
                p = uni(w)
            up[level(u)] += n * lam[level(u)] * p / (lam[level(u)] * p + (1 - lam[level(u)]) * uni(w))
            all_[level(u)] += n
        lam = defaultdict(lambda: 0.5, {k: up[k] / all_[k] for k in all_})
    lam[0] = lam[1]

    def prob(u, w):
        if not total[u]:
            return uni(w)
        x = (max(big[u, w] - d, 0) + d * kinds[u] * uni(w)) / total[u]
        return lam[level(u)] * x + (1 - lam[level(u)]) * uni(w)

    out = []
    for (i, _), x in zip(rows, toks, strict=True):
        base = sum(math.log10(uni(w)) for w in x)
        out.append((i, len(x), sum(c[w] > 0 for w in x), base, sum(math.log10(prob(u, w)) for u, w in pairs(x))))
    return out, sum(c.values())


def compare(got, want, n, near):
    got = sorted(got, key=lambda r: (repr(r.doc_id), r.base_score))
    want = sorted(want, key=lambda r: (repr(r[0]), r[3]))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert (g.doc_id, g.n_tokens, g.n_known, g.train_tokens) == (*w[:3], n)
        assert g.base_score == pytest.approx(w[3], rel=1e-9, abs=1e-9)
        assert g.score == pytest.approx(w[4], abs=near * w[1])


def texts(r, n):
    vocab = ["The", "the", "of", "é", "x\ty", "A\n", *(f"w{k}" for k in range(60))]
    out = [" ".join(r.choices(vocab, weights=[9, 9, 9, 3, 1, 1] + [1] * 60, k=r.randint(0, 60))) for _ in range(n)]
    return [(k, out[k // 2] if k % 5 == 0 else t) for k, t in enumerate(out)] + [(n, None), (n + 1, ""), (7, "the of"), (None, "w1 zz")]


def test_against_brute_force(spark):
    rows = texts(random.Random(8), 120)
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, train string, score int").repartition(4)
    train = [d is not None and d % 3 != 1 for d, _ in rows]
    want, n = brute(rows, train)
    compare(L.score(df, F.col("doc_id") % 3 != 1, block_bytes=4000, shard_bytes=1 << 20).collect(), want, n, 0.0005)


def test_many_shards_and_split_contexts(spark):
    """Weights are fitted shard by shard, so scores differ a little; base scores don't."""
    rows = texts(random.Random(9), 150)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    train = [d is not None and d % 3 != 1 for d, _ in rows]
    want, n = brute(rows, train)
    got = L.score(df, F.col("doc_id") % 3 != 1, block_bytes=3000, shard_bytes=6000, hot=20).collect()
    compare(got, want, n, 0.25)
    assert sum(r.score for r in got) == pytest.approx(sum(w[4] for w in want), rel=0.05)


def test_probabilities_add_up_to_one():
    r = np.random.default_rng(3)
    vocab = 50
    uni = r.random(vocab)
    uni /= uni.sum()
    part = np.arange(vocab) % 2  # a split context in two halves, and a whole one
    times = r.integers(0, 4, (2, vocab))
    rows = [(times[0], np.flatnonzero((times[0] > 0) & (part == k)), uni[part == k].sum()) for k in (0, 1)]
    rows.append((times[1], np.flatnonzero(times[1]), 1.0))
    total = np.array([times[0].sum(), times[0].sum(), times[1].sum()], float)
    counts = np.array([len(x[1]) for x in rows])
    children = np.concatenate([x[1] for x in rows])
    back, prob = L.smoothed(np.arange(3), total, np.array([x[2] for x in rows]), counts,
                            np.concatenate([x[0][x[1]] for x in rows]), uni[children])
    edge = np.cumsum([0, *counts])
    whole = []
    for k in range(3):
        mine = children[edge[k] : edge[k + 1]]
        out = np.setdiff1d(np.flatnonzero(part == k) if k < 2 else np.arange(vocab), mine)
        whole.append(prob[edge[k] : edge[k + 1]].sum() + back[k] * uni[out].sum())
    assert whole[0] + whole[1] == pytest.approx(1) and whole[2] == pytest.approx(1)


@pytest.mark.parametrize("top", [1, 40, 1 << 20, (1 << 62) - 1])
@pytest.mark.parametrize("n", [0, 1, 2, 500])
def test_elias_fano(n, top):
    r = np.random.default_rng(n)
    x = np.sort(r.integers(0, top, n).astype(np.uint64)) if top > 1 else np.zeros(n, np.uint64)
    e = EliasFano(*EliasFano.pieces(x))
    assert (e.get(np.arange(n)) == x).all()
    q = np.concatenate((x, r.integers(0, top + 1, 200).astype(np.uint64), np.array([0, top], np.uint64)))
    assert (e.successor(q) == np.searchsorted(x, q)).all()


def test_trie_in_memory_and_in_a_file(tmp_path):
    r = np.random.default_rng(5)
    contexts = np.unique(r.integers(0, 1 << 48, 300).astype(np.uint64))
    kids = [np.unique(r.integers(0, 1 << 40, r.integers(0, 30)).astype(np.uint64)) for _ in contexts]
    counts = np.array([len(k) for k in kids])
    weight, prob = -r.random(len(contexts)), -9 * r.random(counts.sum())
    data = Trie.build(contexts, weight, counts, np.concatenate(kids), prob)
    (tmp_path / "t").write_bytes(data)
    known = {(int(c), int(k)): p for c, ks, ps in zip(contexts, kids, np.split(prob, np.cumsum(counts)[:-1]), strict=True)
             for k, p in zip(ks, ps, strict=True)}
    bow = dict(zip(contexts.tolist(), weight, strict=True))
    asked = list(known) + [(int(r.choice(contexts)), int(r.integers(0, 1 << 40))) for _ in range(200)] + [(5, 6)]
    want = [known.get(q, bow.get(q[0], 0) - 3.0) for q in asked]
    c, k = (np.array(x, np.uint64) for x in zip(*asked, strict=True))
    for t in (Trie(data), Trie.mapped(data), Trie.open(str(tmp_path / "t"))):
        assert np.allclose(t.log10(c, k, np.full(len(c), -3.0)), want, atol=1e-3)
    assert len(data) < 8.5 * counts.sum() + 14 * len(contexts) + 1500


def test_query(spark, sf):
    rows = [tuple(r) for r in read(spark, sf, "documents").select("doc_id", "text").collect()]
    train = [zlib.crc32(str(d).encode()) % 7 != 2 for d, _ in rows]
    want, n = brute(rows, train)
    got = QUERIES["op1_lm"](spark, sf).collect()
    compare(got, want, n, 0.0005)
    assert {r.doc_id for r in got if r.held_out} == {d for (d, _), t in zip(rows, train, strict=True) if not t}
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert L.score(df, F.lit(True)).count() == 0
    one = L.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(False)).first()
    assert (one.n_tokens, one.n_known, one.train_tokens, one.base_score, one.score) == (3, 0, 0, 0.0, 0.0)
