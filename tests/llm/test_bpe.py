import hashlib
import random
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from eventide.llm import bpe as B
from eventide.llm.common import read
from eventide.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
AUTOMATON = B.automaton(open(PATH, encoding="utf-8").read())
PIECES = ["a", "aa", "the", "é", "中", " ", "  ", "\n", "'s", "<|endoftext|>", "<|endof", "12", "!!", "\U0001f600", "́", "\0",
          "　", "in", "g", "ing", "er", "ou"]


def lib(x):
    return LIB.encode(x, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(), st.lists(st.sampled_from(PIECES), max_size=14).map("".join)))
def test_equals_the_library(x):
    ids = AUTOMATON.encode(x)
    assert ids == lib(x)
    assert AUTOMATON.decode(ids) == LIB.decode(ids, skip_special_tokens=False) == x


def test_invalid_bytes_decode_alike():
    r = random.Random(2)
    for _ in range(300):
        ids = [r.randrange(50257) for _ in range(r.randint(0, 6))]
        assert AUTOMATON.decode(ids) == LIB.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("letters", ["a", "ab", "etaoin shrdlu"])
def test_very_long_words(letters):
    r = random.Random(4)
    x = "".join(r.choice(letters) for _ in range(150_000))
    assert AUTOMATON.encode(x) == lib(x)


def test_gadgets_against_merging_in_order():
    """On random small merge lists the automaton's path is what merging by rank gives."""
    r = random.Random(9)
    for _ in range(40):
        vocab, merges = {c: i for i, c in enumerate("abc")}, []
        for _ in range(r.randint(1, 12)):
            a, b = r.choice(list(vocab)), r.choice(list(vocab))
            if a + b not in vocab:
                vocab[a + b] = len(vocab)
                merges.append((a, b))
        auto = B.Automaton(vocab, merges)
        for _ in range(60):
            x = [r.choice("abc") for _ in range(r.randint(1, 12))]
            want = list(x)
            for a, b in merges:
                i = 0
                while i < len(want) - 1:
                    if (want[i], want[i + 1]) == (a, b):
                        want[i : i + 2] = [a + b]
                    i += 1
            assert [auto.bytes_of[t].decode() for t in auto.word("".join(x).encode())] == want


def test_table_against_gadgets_laid_one_by_one():
    """The rectangles are the matrix that copying rows and columns merge after merge gives, also for merges of equal parts."""
    r = random.Random(3)
    for _ in range(60):
        letters = "abcd"[: r.randint(1, 4)]
        vocab, merges = {c: i for i, c in enumerate(letters)}, []
        gone = {i: set() for i in vocab.values()}  # state -> closed arcs
        for _ in range(r.randint(0, 25)):
            a, b = r.choice(list(vocab)), r.choice(list(vocab))
            u, v = vocab[a], vocab[b]
            if a + b in vocab or v in gone[u]:
                continue
            w = vocab[a + b] = len(vocab)
            merges.append((a, b))
            gone[w] = set(gone[v])
            gone[u].add(v)
            for arcs in gone.values():
                if u in arcs:
                    arcs.add(w)
        auto = B.Automaton(vocab, merges)
        assert {(x, y) for x in gone for y in gone if not auto.follows(x, y)} == {(x, y) for x in gone for y in gone[x]}


def test_table_is_small_and_words_are_read_once():
    assert len(set(AUTOMATON.state)) < 15_000 and len(set(AUTOMATON.closed)) < 11_000
    assert sum(map(len, set(AUTOMATON.closed))) < 20 << 20
    assert AUTOMATON.word(b"") == ()
    with pytest.raises(ValueError):
        B.Automaton({"a": 0, "b": 1, "ab": 2}, [("a", "b")]).word(b"abx")


def test_query(spark, sf):
    rows = {r.doc_id: r for r in QUERIES["op9_bpe"](spark, sf).collect()}
    docs = read(spark, sf, "documents").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = lib(d.text or "")
        want = hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest()
        got = rows[d.doc_id]
        assert (got.n_tokens, got.ids_sha256, got.decoded_sha256) == (len(ids), *want)


def test_edge_cases(spark):
    rows = [(1, None, 5), (2, "", 6), (3, "x\n" * 9, None), (3, "x\n" * 9, None), (None, "<|endoftext|>y", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").withColumnRenamed("n", "extra")
    out = B.encoded(df, PATH)
    got = {(r.doc_id, r.extra, r.n_tokens, bytes(r.ids)) for r in out.collect()}
    assert got == {(d, n, len(lib(t or "")), struct.pack(f"<{len(lib(t or ''))}I", *lib(t or ""))) for d, t, n in rows}
    back = sorted(((r.doc_id, r.text) for r in B.decoded(out, PATH).collect()), key=repr)
    assert back == sorted(((d, t or "") for d, t, _ in rows), key=repr)
    assert B.encoded(df.where("false"), PATH).count() == 0
