import random
import re

import pytest

from eventide.llm import licences as L
from eventide.llm import queries as Q

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_base(text):
    """Places of the phrases by looking everywhere."""
    w, out = plain_words(text), []
    for k, (_, phrase) in enumerate(L.PHRASES):
        p = phrase.split()
        out += [(k, i) for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), sorted(out)


def plain_longest(seqs, w):
    """For each end and sequence, the longest run of words ending there that stands in the sequence."""
    out = []
    for i in range(1, len(w) + 1):
        row = {}
        for k, s in enumerate(seqs):
            row[k] = max((n for n in range(1, i + 1) if any(s[j : j + n] == w[i - n : i] for j in range(len(s) - n + 1))), default=0)
        out.append(row)
    return out


def test_automaton_gives_matching_statistics():
    r = random.Random(5)
    for _ in range(40):
        seqs = [[r.choice("abc") for _ in range(r.randint(2, 12))] for _ in range(4)]
        s = L.Scanner(tuple((f"l{k}", " ".join(x)) for k, x in enumerate(seqs)), ())
        text = [r.choice("abcd") for _ in range(40)]
        want = plain_longest(seqs, text)
        state = run = 0
        for w, row in zip(text, want, strict=True):
            state, run = s.automaton.step(state, run, s.vocabulary.get(w.encode(), 0))
            assert run == max(row.values())
            got = {k: min(n, run) for k, (n, _) in s.best[state].items() if min(n, run) >= L.LEAST}
            assert got == {k: n for k, n in row.items() if n >= L.LEAST}
            for k, (n, ends) in s.best[state].items():
                n = min(n, run)
                if n >= L.LEAST:
                    tail = text[: len(text)][max(0, want.index(row) + 1 - n) : want.index(row) + 1] if want.count(row) == 1 else None
                    assert tail is None or all(seqs[k][e - n : e] == tail for e in ends)


def test_places_against_a_plain_search():
    r = random.Random(1)
    vocabulary = "gnu general public license apache cc by mit the Version 2 x é License-".split()
    s = L.scanner()
    for _ in range(300):
        text = "".join(r.choice(vocabulary) + r.choice([" ", ", ", "-", "\n", "_", ""]) for _ in range(r.randint(0, 40)))
        n, places, _ = s.scan(text)
        assert (n, sorted(places)) == plain_base(text)


def test_chains_need_not_be_contiguous():
    s = L.scanner()
    grant = L.words(L.TEMPLATES[0][1])
    whole = " ".join(x.decode() for x in grant)
    assert [x[0] for x in s.scan(f"a b {whole} c")[2] if x[4] == 1.0] == ["mit"]
    w = [x.decode() for x in grant]
    w[20:22] = ["another", "three", "words"]  # an edited copy
    del w[60:64]
    spans = [x for x in s.scan("intro " + " ".join(w))[2] if x[0] == "mit" and x[4] >= L.SHARE]
    assert len(spans) == 1 and spans[0][1] == 1 and len(grant) - 12 <= spans[0][3] < len(grant)
    twice = f"{whole} {'filler ' * 40} {whole}"
    assert [(x[1], x[2]) for x in s.scan(twice)[2] if x[0] == "mit" and x[4] == 1.0] == [(0, len(grant)), (len(grant) + 40, len(grant))]
    random.Random(2).shuffle(w)
    assert not [x for x in s.scan(" ".join(w))[2] if x[4] >= L.SHARE]


def test_covered_words_never_exceed_the_template():
    r = random.Random(9)
    s = L.Scanner((("t", "a b c a b c d a b c d e"), ("u", "c d e a b c")), ())
    for _ in range(300):
        text = " ".join(r.choice("abcdex") for _ in range(60))
        for _, first, n, covered, share in s.scan(text)[2]:
            assert 0 < share <= 1 and covered <= n and 0 <= first and first + n <= 60


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_pieces_do_not_cut_words(monkeypatch, piece):
    monkeypatch.setattr(L, "PIECE", piece)
    text = "  GNU General\tPublic License " * 50 + "ééé" * 100
    assert [w.decode() for w in L.words(text)] == plain_words(text)


def test_rows(spark):
    rows = [
        (1, "Licensed under CC BY-NC 4.0.", "x"), (1, None, "y"), (None, "", "z"), (2, "Released under the MIT License. " * 3, ""),
        (3, "mit licence", None), (4, "x " * 300_000 + "gnu general public license", "n"), (5, "MIT license mit LICENSE", "l"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = {(x.doc_id, x.n_words): x for x in L.scan(df).collect()}
    assert len(got) == len(rows) and "spans" in L.scan(df).columns
    a = got[1, 7]
    assert (a.n_base, a.first_word, a.last_word, a.base_labels, a.labels, a.score) == (1, 2, 2, "cc-by", "cc-by,cc-by-nc", 1.0)
    for k in ((1, 0), (None, 0)):
        assert (got[k].n_base, got[k].first_word, got[k].last_word, got[k].base_labels, got[k].labels, got[k].score) == (0, None, None, "", "", 0.0)
    assert (got[2, 15].n_base, got[2, 15].first_word, got[2, 15].last_word, got[2, 15].labels) == (3, 3, 13, "mit")
    assert got[3, 2].n_base == 0 and got[4, 300_004].first_word == 300_000
    assert (got[5, 4].n_base, got[5, 4].first_word, got[5, 4].last_word) == (2, 0, 2)
    assert L.scan(df.limit(0)).count() == 0


def test_query_against_a_plain_search(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = Q.op13_licences(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        n, places = plain_base(docs[r.doc_id])
        starts = [i for _, i in places]
        base = sorted({L.PHRASES[k][0] for k, _ in places})
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(base) and set(base) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.score == 1 or not base
