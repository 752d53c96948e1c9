import random
from collections import Counter

import pytest

from eventide.llm import decontaminate as D
from eventide.llm.common import read
from eventide.llm.queries import QUERIES


def brute(docs, items, similarity=0.8):
    """(doc, item) where some stretch of twice the longest item holds enough of the item's shingles."""
    out = Counter()
    longest = max((len(D.terms(t)) for _, t in items), default=0)
    for d, text in docs:
        w = D.terms(text)
        for i, t in items:
            want = D.shingles(D.terms(t))
            if not want or not w:
                continue
            n = len(next(iter(want)))
            have = [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
            spots = [k for k, s in enumerate(have) if s in want]
            if any(len(want & set(have[k : k + longest])) / len(want) >= similarity for k in spots):
                out[d, i] += 1
    return out


def test_wand_finds_what_full_scoring_finds():
    r = random.Random(3)
    vocab = [f"t{k}" for k in range(120)]
    items = [(i, " ".join(r.choices(vocab, weights=[1 / (k + 1) for k in range(120)], k=r.randint(1, 25)))) for i in range(300)]
    ix = D.Index(items, share=0.4)
    assert ix.width > 1
    for _ in range(300):
        q = {k for k in range(len(ix.term)) if r.random() < r.choice([0.02, 0.2, 0.6])}
        score = Counter()
        for t in q:
            for d, x in zip(ix.docs[t], ix.weights[t], strict=True):
                score[d] += x
        want = {d for d, x in score.items() if x >= 1 - 1e-9}
        assert {d for d, _ in ix.search(q)} == want
        assert all(abs(x - score[d]) < 1e-9 for d, x in ix.search(q))


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in read(spark, sf, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in read(spark, sf, "benchmark").collect()]
    got = QUERIES["op5_decontaminate"](spark, sf).collect()
    assert Counter((r.doc_id, r.item_id) for r in got) == brute(docs, items) and len(got) > 5
    assert all(r.overlap >= 0.8 and 0.7 <= r.score <= 1.0001 for r in got)


ITEMS = [(1, "Who wrote the long book about whales and the sea?\nHerman Melville in eighteen fifty one"), (2, "two words"),
         (3, None), (4, " . \n"), (1, "Name the capital of the old kingdom beyond the hills. It is the town of Veld."), (9, None)]
DOCS = [(1, "x " * 500 + "WHO wrote the long book about whales, and the sea? Herman Melville in eighteen fifty one%%% y"), (2, None), (3, ""),
        (4, "who wrote the long book about cats and the sea herman melville in eighteen fifty one"), (5, "words two words! two"),
        (5, "words two words! two"), (None, "name the capital of the old kingdom beyond the hills it is the town of veld " * 3), (7, "whales and the sea")]


@pytest.mark.parametrize("index_bytes", [1 << 20, 60])
def test_edge_cases(spark, index_bytes):
    """With a tiny index the items take several passes."""
    docs = spark.createDataFrame([(*d, "k", 1.0) for d in DOCS], "doc_id long, text string, item_id string, score double")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = D.marked(docs, items, index_bytes=index_bytes).collect()
    assert len(rows) == len(DOCS) and rows[0].item_id == "k"
    got = Counter((r.doc_id, x.item_id) for r in rows for x in r.leaks)
    assert got == {(1, 1): 1, (5, 2): 2, (None, 1): 1}
    assert D.leaks(docs.where("false"), items).count() == 0 == D.leaks(docs, items.where("false")).count()


def test_ids_are_carried_as_they_are(spark):
    docs = spark.createDataFrame([(*d, "kept") for d in DOCS], "doc_id long, text string, leaks string")
    items = spark.createDataFrame([(None, ITEMS[0][1]), ("abc", "two words"), ("abc", "two words")], "item_id string, text string")
    got = Counter((r.doc_id, x.item_id) for r in D.marked(docs, items).collect() for x in r.leaks)
    assert got == {(1, None): 1, (5, "abc"): 4}
    assert Counter((r.doc_id, r.item_id) for r in D.leaks(docs, items).collect()) == got
