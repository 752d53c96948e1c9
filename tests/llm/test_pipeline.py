import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from eventide.llm import similar
from eventide.llm.common import read, words


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("group", [64, 3])
def test_similar_pairs_against_all_pairs(spark, group):
    r = random.Random(4)
    vocab = [f"v{k}" for k in range(500)]
    base = [r.choices(vocab, k=n) for n in (30, 60, 120, 200, 300) for _ in range(6)]
    rows = [(k, " ".join(b)) for k, b in enumerate(base)]
    for k in range(60):
        b = list(base[k % len(base)])
        for _ in range(r.randint(0, max(1, len(b) // 50))):
            b[r.randrange(len(b))] = r.choice(vocab)
        rows.append((100 + k, " ".join(b)))
    rows += [(200, None), (201, ""), (202, "a b"), (203, "A  b"), (204, "a b c"), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x.a, x.b) for x in similar.similar_pairs(df, "doc_id", "text", group=group).collect()}
    sets = {d: shingles(t) for d, t in rows if d is not None and words(t)}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in sorted(got):
        assert len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    missed = [(a, b) for a, b in want if find(a) != find(b)]
    assert not missed


@pytest.mark.parametrize("group,cell", [(64, 1024), (3, 1024), (3, 20)])
def test_large_groups_are_joined_whatever_the_least_id(spark, monkeypatch, group, cell):
    """Copies that are each close to an original with a later id, and not to one another; a chain; with small cells too."""
    monkeypatch.setattr(similar, "CELL_ROWS", cell)
    r = random.Random(9)
    vocab = [f"v{k}" for k in range(5000)]
    original = r.choices(vocab, k=400)
    rows = [(900, " ".join(original))]
    for k in range(100):
        b = list(original)
        for at in r.sample(range(0, 400, 9), 8):
            b[at] = r.choice(vocab)
        rows.append((k, " ".join(b)))
    chain = r.choices(vocab, k=330)
    for k in range(90):
        chain = list(chain)
        chain[(k * 3) % 30] = r.choice(vocab)
        if k % 3 == 0:
            chain[30 + k % 300] = r.choice(vocab)
        rows.append((1000 + k * 37 % 90, " ".join(chain)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x.a, x.b) for x in similar.similar_pairs(df, "doc_id", "text", group=group).collect()}
    sets = {d: shingles(t) for d, t in rows}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    assert all(like(a, b) for a, b in got)

    def parts(pairs):
        at = {d: d for d in sets}
        for a, b in pairs:
            lo, hi = sorted((at[a], at[b]))
            at = {d: lo if x == hi else x for d, x in at.items()}
        return at

    want = parts((a, b) for a in sets for b in sets if a < b and like(a, b))
    assert parts(got) == want and len({want[d] for d in range(100)} | {want[900]}) == 1


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs, out = read(spark, sf, "documents"), {}
    out["input"], folder = docs, tmp_path_factory.mktemp("stages")
    for name, stage in P.STAGES:
        docs = stage(spark, docs, sf)
        docs.write.parquet(str(folder / name))
        docs = out[name] = spark.read.parquet(str(folder / name))
    return out


def test_stages_in_order(stages, spark, sf):
    names = ["input", *[n for n, _ in P.STAGES]]
    counts = [stages[n].count() for n in names]
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2] > 0
    for n in names[:-1]:
        assert stages[n].dtypes == stages["input"].dtypes
    assert Counter(r.round_trip for r in stages["tokens"].collect()) == {True: counts[-1]}
    assert counts[1] > 0.97 * counts[0]
    text = {r.doc_id: r.text for r in stages["input"].collect()}
    left = {r.doc_id for r in stages["near"].collect()}
    first = {}
    for d in sorted(r.doc_id for r in stages["language"].collect()):
        first.setdefault(" ".join(text[d].split()), d)
    assert not {d for d in left if first[" ".join(text[d].split())] != d}  # of equal texts the first alone
    items = {r.text for r in read(spark, sf, "benchmark").collect()}
    assert not [r for r in stages["benchmark"].collect() if any(i in r.text for i in items)]
    got = P.run(spark, sf)
    assert sorted(map(str, got.collect())) == sorted(map(str, stages["tokens"].collect()))


def test_edge_cases(spark, sf):
    r = random.Random(1)
    de = ["der", "und", "nicht", "eine", "schön", "auch", "wird", "zwei"]
    en = ["the", "and", "with", "this", "from", "have", "which", "there"]
    make = lambda v, n: " ".join(r.choice(v) + r.choice(["", "s", "en", "ing", "ly"]) for _ in range(n))
    rows = [(k, make(de if k % 2 else en, 80), "de" if k % 2 else "en", "s", 1) for k in range(60)]
    rows += [(100, None, "en", None, None), (101, "", None, "s", 0), (102, "123 456", "en", "s", 7), (None, make(en, 70), "en", "s", 1),
             (103, rows[3][1], "de", "t", 1), (104, rows[4][1], "en", "t", 2), (104, rows[4][1], "en", "t", 2),
             (105, make(en, 60), "en", "u", 3), (105, None, "en", "u", 3)]
    docs = documents(spark, rows).withColumn("id", F.lit("clash")).withColumn("ids", F.lit(1)).withColumn("kept", F.lit(2))
    names = "lang_ok lang_pred lang_score leaks rest row block key size spans component_id fingerprint".split()
    docs = docs.select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    for name, stage in P.STAGES[:-1]:
        empty = stage(spark, docs.where("false"), sf)
        assert empty.columns == docs.columns and empty.count() == 0
        for row in stage(spark, docs, sf).select(*[f"`{n}`" for n in names]).distinct().collect():
            assert tuple(row) == tuple(f"own {n}" for n in names), name
    lang = P.language(spark, docs, sf)
    assert Counter(x.doc_id for x in lang.collect() if x.doc_id is None or x.doc_id > 99) == {None: 1, 103: 1, 104: 2, 105: 1}
    near = P.near(spark, docs, sf)
    left = Counter(x.doc_id for x in near.collect())
    assert 103 not in left and 104 not in left and left[None] == 1 and 105 not in left and left[3] == left[4] == 1
    assert sum(left[d] for d in (100, 101)) == 1  # two texts without words are one group
    exact = {(x.doc_id, x.text, x.kept) for x in P.exact(spark, docs, sf).collect()}
    assert (3, rows[3][1], 2) in exact and not {x for x in exact if x[0] in (103, 104)} and (101, "", 2) in exact
    assert P.benchmark(spark, docs, sf).count() == len(rows)
    out = {(x.doc_id, x.n_tokens, x.round_trip) for x in P.tokens(spark, docs, sf).collect()}
    assert (100, 0, True) in out and len(out) >= 65


def test_cuts_through_characters(spark, sf):
    shared = "é" * 40
    docs = documents(spark, [(1, "a" + shared + "b", "fr", "s", 1), (2, "xyz" + shared[:30] + "ö" + "w", "fr", "s", 1)])
    got = {x.doc_id: (x.text, x.n_chars) for x in P.exact(spark, docs, sf).collect()}
    assert got[1] == ("a" + shared + "b", 42) and got[2][1] == len(got[2][0]) and got[2][0].startswith("xyz") and got[2][0].endswith("w")
