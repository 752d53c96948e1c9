import numpy as np
from pyspark.sql import functions as F

from eventide.llm import common as C
from eventide.operators.components import components


def test_pack():
    arrays = [np.arange(5, dtype=np.uint64), np.zeros(0, np.uint8), np.array([-1, 2], np.int32), np.array([0.5], "<f4")]
    back = C.unpack(C.pack(*arrays))
    assert [a.dtype for a in back] == [a.dtype for a in arrays]
    assert all((a == b).all() for a, b in zip(arrays, back, strict=True))


def test_words():
    assert C.words("A\x85b\tC\x0bd é É") == [b"a\xc2\x85b", b"c", b"d", "é É".encode()]
    assert C.words(None) == C.words("") == C.words(" \n") == []


def test_blocks_hold_whole_rows_once(spark):
    rows = [(k, "x" * (k % 50) if k % 9 else None, f"o{k}") for k in range(300)] + [(None, "y" * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block string").repartition(3)
    b = C.blocked(df, "doc_id", "text", 400, rows=20, others=("block",))
    got = b.collect()
    assert sorted((r.id, r.text, r.rest.block) for r in got if r.id is not None) == [(d, t or "", o) for d, t, o in rows[:-1]]
    size = {}
    for r in got:
        size.setdefault(r.block, []).append((r.row, len(r.text)))
    for parts in size.values():
        assert sorted(x for x, _ in parts) == list(range(len(parts))) and len(parts) <= 20
        assert sum(n for _, n in parts) <= 400 or len(parts) == 1
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("llm_blocks_")]


def test_components(spark):
    edges = [(5, 4), (4, 3), (9, 9), (10, 20), (20, 30), (30, 10), (7, 100), (100, 50), (3, 2), (2, 1), (1, 1)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.a: r.b for r in components(df).collect()}
    assert got == {5: 1, 4: 1, 3: 1, 2: 1, 20: 10, 30: 10, 50: 7, 100: 7}
    assert components(df.where("a < 0")).count() == 0
    chain = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert components(chain).agg(F.max("b"), F.count("*")).first() == (0, 199)
