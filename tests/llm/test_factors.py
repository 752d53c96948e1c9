import hashlib
import random

import numpy as np
import pytest

from eventide.llm import factors as X
from eventide.llm.common import read
from eventide.llm.queries import QUERIES


def brute(rows, length):
    """Kept bytes and removed runs by a plain index of every string of ``length`` bytes."""
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            if d is not None:
                s = b[i : i + length]
                first[s] = min(d, first.get(s, d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if d is not None and first[b[i : i + length]] < d:
                gone[i : i + length] = [True] * length
        runs = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in df.collect()), key=repr)


def test_window_anchors_depend_on_the_window_alone():
    r = np.random.default_rng(1)
    b = r.integers(97, 99, 3000).astype(np.uint8)
    place, hashes = X.window_anchors(b, 20, 6)
    seen = {}
    for i in range(len(place)):
        w = b[i : i + 20].tobytes()
        assert i <= place[i] <= i + 14
        assert seen.setdefault(w, (place[i] - i, hashes[i])) == (place[i] - i, hashes[i])
    piece, X._PIECE = X._PIECE, 64
    try:
        assert all((x == y).all() for x, y in zip(X.window_anchors(b, 20, 6), (place, hashes), strict=True))
    finally:
        X._PIECE = piece


def test_suffix_order_and_previous_factors():
    r = random.Random(2)
    for _ in range(60):
        text = bytes(r.choice(b"ab") for _ in range(r.randint(30, 200)))
        n = r.choice([8, 11, 19])
        starts = np.array(sorted(r.sample(range(len(text) - n + 1), min(len(text) - n + 1, 80))))
        owner = np.array([r.randrange(6) for _ in starts])
        at, same = X.suffix_order(np.frombuffer(text, np.uint8), starts, owner, n)
        strings = [text[starts[i] : starts[i] + n] for i in at]
        assert strings == sorted(strings)
        assert [bool(x) for x in same] == [k > 0 and strings[k] == strings[k - 1] for k in range(len(at))]
        hit = set(at[X.has_earlier(owner[at], same)].tolist())
        want = {i for i in range(len(starts)) for j in range(len(starts)) if owner[j] < owner[i]
                and text[starts[i] : starts[i] + n] == text[starts[j] : starts[j] + n]}
        assert hit == want


def made(r, n):
    base = ["".join(r.choice("abcdé ") for _ in range(r.randint(0, 300))) for _ in range(n // 3)]
    rows = []
    for d in range(n):
        parts = [r.choice(base)[r.randint(0, 60) :] if r.random() < 0.6 else "".join(r.choice("xyz") for _ in range(r.randint(0, 90)))
                 for _ in range(r.randint(0, 4))]
        rows.append((r.choice([d, d, d // 2, None]) if d % 9 == 0 else d, "".join(parts)))
    return rows + [(3, "a" * 700), (999, "a" * 700), (998, None), (997, ""), (5, base[0]), (5, base[0])]


@pytest.mark.parametrize("hot", [2000, 2])
@pytest.mark.parametrize("length,gram", [(50, 20), (24, 7)])
def test_against_brute_force(spark, hot, length, gram):
    """Blocks and shards of a few texts; with hot=2 nearly all passages travel as single windows."""
    rows = made(random.Random(hot + length), 60)
    df = spark.createDataFrame([(d, t, "e", d) for d, t in rows], "doc_id long, text string, kept string, row long").repartition(5)
    out = X.without_repeats(df, length=length, gram=gram, block_bytes=3000, shard_bytes=2000, hot=hot, others=("kept", "row"))
    assert got(out) == brute(rows, length)
    assert {r.rest.kept for r in out.collect()} == {"e"} and all(r.rest.row == r.id for r in out.collect())


def test_query(spark, sf):
    rows = [tuple(r) for r in read(spark, sf, "documents").select("doc_id", "text").collect()]
    out = QUERIES["op2_factors"](spark, sf).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out), key=repr) == brute(rows, 50)


def test_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert X.without_repeats(df).count() == 0
    one = spark.createDataFrame([(1, None), (2, "x")], "doc_id long, text string")
    assert got(X.without_repeats(one)) == brute([(1, None), (2, "x")], 50)
