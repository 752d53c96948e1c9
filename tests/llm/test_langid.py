import random
import zlib

import numpy as np
import pandas as pd
import pytest

from eventide.llm import langid as L
from eventide.llm.common import read
from eventide.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = read(spark, sf, "documents").select("doc_id", "text", "lang").toPandas().set_index("doc_id")
    out = QUERIES["op4_langid"](spark, sf).toPandas()
    assert len(out) == len(docs) and out["score"].between(0, 1).all()
    fold = np.array([zlib.crc32(str(d).encode()) % 4 == 2 for d in out["doc_id"]])
    assert (out["held_out"].to_numpy() == fold).all() and 0 < fold.sum() < len(fold)
    hits = out["lang_pred"].to_numpy() == docs.loc[out["doc_id"], "lang"].to_numpy()
    assert hits[fold].mean() > 0.98 and out["accepted"].mean() > 0.99


def test_long_texts_are_read_whole():
    rng = np.random.default_rng(1)
    m = L.train([L.profile("aa bb ab"), L.profile("xx yy xy")] * 8, ["p", "q"] * 8)
    assert m.predict("xy xx")[0] == "q" and m.predict("ab aa")[0] == "p"
    long = "aa " * 40 + "xy " * L.CHUNK
    assert m.predict(long)[0] == "q"
    words = [rng.choice(["aa", "xy"]) for _ in range(3000)]
    whole = m.probabilities(" ".join(words))
    chunk, L.CHUNK = L.CHUNK, 100
    try:
        assert np.allclose(whole, m.probabilities(" ".join(words)), atol=0.02)
    finally:
        L.CHUNK = chunk


def test_edge_cases(spark):
    rows = [(1, "aa bb ab", "p", 1.0), (2, "xx yy xy", "q", 1.0), (3, None, "p", 1.0), (4, "", None, 1.0),
            (5, "12 34", "p", 1.0), (6, "ab", None, 1.0), (6, "ab", None, 1.0), (None, "xy", "q", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_score double")
    df = df.selectExpr("*", "'x' AS lang_ok", "1 AS lang_pred", "2 AS key")
    out = L.identify(df, df).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    for d in (3, 4, 5):
        assert (by[d].lang_pred, by[d].lang_score, by[d].lang_ok) == ("und", 0.0, False)
    assert by[6].lang_pred in ("p", "q") and by[None].lang_pred in ("p", "q")
    nothing = L.identify(df.drop("lang_score"), df.where("false")).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert L.identify(df.drop("lang_score").where("false"), df).count() == 0


@pytest.mark.parametrize("langs", [["en"], ["fr"], ["de", "en"], ["de", "en", "es", "fr"]])
def test_foreign_and_junk_texts_are_rejected(langs):
    r = random.Random(2)
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text", "lang"])
    docs = docs[docs["text"].map(L.has_letter)]
    known, new = docs[docs["doc_id"] % 4 != 2], docs[docs["doc_id"] % 4 == 2]
    known = known[known["lang"].isin(langs)]
    m = L.train([L.profile(t) for t in known["text"]], list(known["lang"]))
    share = lambda texts: np.mean([m.predict(t)[2] for t in texts])
    assert share(new["text"][new["lang"].isin(langs)]) > 0.99
    foreign = list(new["text"][~new["lang"].isin(langs)])
    assert not foreign or share(foreign) < 0.05
    letters = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=300)) for _ in range(40)]
    shuffled = ["".join(r.sample(t, len(t))) for t in new["text"] if len(t) > 200]
    assert share(letters) == 0 and share(shuffled) < 0.05
    assert share(["Tämä on suomenkielinen teksti jota kukaan ei ymmärrä ilman sanakirjaa", "Это русский текст, он не похож на другие",
                  "Ala ma kota, a kot ma mleko i pije je codziennie rano przed wyjściem na spacer"]) == 0


def test_no_language_is_lost_to_repeated_rows_or_null_ids(spark):
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text", "lang"])
    docs = docs[docs["text"].map(L.has_letter)]
    rows = [(int(d), t, lang) for d, t, lang in docs.itertuples(index=False) if lang != "en"]
    one = next((int(d), t, lang) for d, t, lang in docs.itertuples(index=False) if lang == "en")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    many = spark.createDataFrame([one], df.schema).crossJoin(spark.range(20_000)).drop("id")
    assert L.fit(df.unionByName(many), "doc_id", "text", "lang").langs == ["de", "en", "es", "fr"]
    null_ids = spark.createDataFrame([(None, t, lang) for _, t, lang in docs.itertuples(index=False)], df.schema)
    m = L.fit(null_ids, "doc_id", "text", "lang")
    assert m.langs == ["de", "en", "es", "fr"]
    assert np.mean([m.predict(t)[0] == lang for t, lang in zip(docs["text"], docs["lang"], strict=True)]) > 0.97


def test_sample_against_a_plain_ranking(spark):
    """The sample is the per_lang least hashes of each language, whatever the copies; its training is plain numpy."""
    rows = [(k % 40, f"text {'ab' if k % 2 else 'xy'} {k % 7}", "p" if k % 2 else "q") for k in range(400)] + [(1, "12", "p"), (2, None, "q"), (3, "ab", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    keys = df.selectExpr("lang", "text", "xxhash64(CAST(doc_id AS STRING), text) AS k").where("lang IS NOT NULL AND text LIKE 'text%'").distinct().collect()
    want = [x for lang in ("p", "q") for x in sorted((r.lang, r.k, r.text) for r in keys if r.lang == lang)[:9]]
    m = L.fit(df, "doc_id", "text", "lang", per_lang=9)
    plain = L.train([L.profile(t) for _, _, t in want], [lang for lang, _, _ in want])
    assert m.langs == plain.langs and np.array_equal(m.table, plain.table) and (m.floor, m.least) == (plain.floor, plain.least)
