"""Benchmark decontamination: training passages as queries on a BM25 index of test items, by block-max WAND."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import annotate

SHINGLE = 5
K1, B = 1.2, 0.75
BLOCKS = 64  # stretches of items that have a bound for each term
INDEX_BYTES = 8 << 20  # item text in one index; more items take more passes
TERM = re.compile(r"[^\W_]+")


def terms(text: str | None) -> list[str]:
    """Runs of letters and digits, in lower case; marks between and around words don't count."""
    return TERM.findall(text.lower()) if text else []


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's last line is its answer; in one line, its last sentence; a lone sentence is all question."""
    lines = [x for x in text.split("\n") if terms(x)]
    if len(lines) < 2:
        lines = [x for x in re.split(r"(?<=[.?!])\s+", text) if terms(x)]
    if len(lines) < 2:
        return terms(text), []
    return [w for x in lines[:-1] for w in terms(x)], terms(lines[-1])


def shingles(w: list[str]) -> set[tuple[str, ...]]:
    return {tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()


@dataclass(frozen=True)
class Hit:
    item: object  # its id
    score: float  # share of the item's own BM25 score
    overlap: float  # share of the item's shingles in the passage
    question: float
    answer: float


class Index:
    """Inverted index of items with block maxima: ``bounds[t, b]`` is the most that term t weighs in block b of the items.

    A posting's weight is the term's BM25 weight in the item over ``share`` of what the item scores against itself, so
    the threshold is 1 for every item and one bound serves all.
    """

    def __init__(self, items: list[tuple[object, str]], share: float = 0.7, similarity: float = 0.8, least: float = 0.5):
        self.share, self.similarity, self.least = share, similarity, least
        self.ids, self.parts, self.shingled, words = [], [], [], []
        for i, text in sorted(items, key=lambda x: (x[1], str(x[0]))):
            q, a = question_and_answer(text)
            if q or a:
                self.ids.append(i)
                self.parts.append((shingles(q), Counter(a)))
                self.shingled.append(shingles(q + a))
                words.append(Counter(q + a))
        n = len(self.ids)
        sizes = [sum(w.values()) for w in words]
        mean = sum(sizes) / max(n, 1)
        self.longest = max(sizes, default=0)
        df = Counter(t for w in words for t in w)
        idf = {t: math.log(1 + (n - k + 0.5) / (k + 0.5)) for t, k in df.items()}
        self.term: dict[str, int] = {t: k for k, t in enumerate(sorted(df))}
        self.docs: list[list[int]] = [[] for _ in self.term]
        self.weights: list[list[float]] = [[] for _ in self.term]
        for d, w in enumerate(words):
            part = {t: idf[t] * k * (K1 + 1) / (k + K1 * (1 - B + B * sizes[d] / mean)) for t, k in w.items()}
            whole = sum(part.values()) * share
            for t, x in part.items():
                self.docs[self.term[t]].append(d)
                self.weights[self.term[t]].append(x / whole)
        self.most = [max(x) for x in self.weights]
        self.width = max(1, math.ceil(n / BLOCKS))
        self.bounds = np.zeros((len(df), math.ceil(n / self.width)))
        for t, (docs, x) in enumerate(zip(self.docs, self.weights, strict=True)):
            np.maximum.at(self.bounds[t], np.array(docs) // self.width, x)

    def search(self, query: set[int]) -> list[tuple[int, float]]:
        """All (item, score) with a score of 1 or more, for distinct query terms; block-max WAND."""
        at = {t: 0 for t in query}
        bound = {t: self.bounds[t].tolist() for t in query}
        found, end = [], len(self.ids)
        here = lambda t: self.docs[t][at[t]] if at[t] < len(self.docs[t]) else end
        while True:
            order = sorted((here(t), t) for t in at)
            total, pivot = 0.0, None
            for k, (d, t) in enumerate(order):
                if d == end:
                    break
                total += self.most[t]
                if total >= 1 - 1e-9:
                    pivot = k
                    break
            if pivot is None:
                return found
            p = order[pivot][0]
            while pivot + 1 < len(order) and order[pivot + 1][0] == p:
                pivot += 1
            block = p // self.width
            if sum([bound[t][block] for _, t in order[: pivot + 1]]) < 1 - 1e-9:  # nothing here: on to the next block
                to = (block + 1) * self.width
                if pivot + 1 < len(order):
                    to = min(to, max(order[pivot + 1][0], p + 1))
                for _, t in order[: pivot + 1]:
                    at[t] = bisect_left(self.docs[t], to, at[t])
                continue
            score = 0.0
            for _, t in order[: pivot + 1]:
                at[t] = i = bisect_left(self.docs[t], p, at[t])
                if i < len(self.docs[t]) and self.docs[t][i] == p:
                    score += self.weights[t][i]
                    at[t] = i + 1
            if score >= 1 - 1e-9:
                found.append((p, score))

    def verify(self, item: int, passage: list[str], seen: set[tuple[str, ...]] | None = None) -> tuple[float, float, float]:
        """Shares of the item's shingles, its question's shingles and its answer's words that the passage holds."""
        seen = shingles(passage) if seen is None else seen
        q, a = self.parts[item]
        every = self.shingled[item]
        if len(every) == 1 and len(next(iter(every))) < SHINGLE:  # a short item has to be there word for word
            n = len(next(iter(every)))
            seen = {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}
            whole = float(next(iter(every)) in seen)
            return whole, whole, whole
        share = lambda x: len(x & seen) / len(x) if x else 1.0
        short = {s for s in q if len(s) < SHINGLE}
        words = Counter(passage)
        question = share(q) if not short else sum(min(k, words[t]) for t, k in Counter(next(iter(short))).items()) / len(next(iter(short)))
        answer = sum(min(k, words[t]) for t, k in a.items()) / sum(a.values()) if a else 1.0
        return share(every), question, answer

    def hits(self, text: str | None) -> list[tuple[int, int, Hit]]:
        """(first word, item, hit) of every item that some passage of a whole text gives away; the best passage each.

        Passages are windows of twice the longest item's words, half of each shared with the next, so that wherever an
        item stands, one passage holds it whole.
        """
        if not self.ids:
            return []
        w = terms(text)
        get, most = self.term.get, self.most
        ids = [get(x, -1) for x in w]
        best: dict[int, tuple[int, Hit]] = {}
        for i in range(0, max(1, len(w) - self.longest), self.longest):
            query = set(ids[i : i + 2 * self.longest])
            query.discard(-1)
            if sum([most[t] for t in query]) < 1 - 1e-9 or self.bounds[list(query)].sum(axis=0).max() < 1 - 1e-9:
                continue
            passage, seen = w[i : i + 2 * self.longest], None
            for d, score in self.search(query):
                seen = seen or shingles(passage)
                overlap, q, a = self.verify(d, passage, seen)
                if overlap >= self.similarity and q >= self.least and a >= self.least:
                    hit = Hit(self.ids[d], score * self.share, overlap, q, a)
                    if d not in best or (hit.overlap, hit.score) > (best[d][1].overlap, best[d][1].score):
                        best[d] = (i, hit)
        return [(i, hit.item, hit) for d, (i, hit) in sorted(best.items())]


HITS = "array<struct<item_id:{},first_word:bigint,score:double,overlap:double,question:double,answer:double>>"


def marked(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    index_bytes: int = INDEX_BYTES, share: float = 0.7, similarity: float = 0.8, least: float = 0.5,
) -> DataFrame:
    """``docs`` with ``leaks``, an array of the test items each row gives away, in place of a column of that name; every row stays.

    A passage is searched with its distinct words; every item that reaches ``share`` of its own BM25 score is checked:
    ``similarity`` of its five-word shingles, and ``least`` of its question and of its answer, must be in the passage.
    Items of fewer than five words must appear word for word.  Null and empty texts leak nothing, items without words are
    never found, repeated items and rows each count, whole texts are searched, and no items or rows give no leaks.  Item ids
    are carried as they are, of any type, null or repeated.

    The items are read in parts of at most ``index_bytes`` of text, each indexed and broadcast; a part is one pass of
    Python over the rows, so any number of items takes the same memory.  No row is shuffled.
    """
    c = F.col
    known = items.where(c(item_text).isNotNull()).select(c(item_id).alias("i"), c(item_text).alias("t"))
    size = known.agg(F.sum(F.octet_length("t")).alias("n")).first().n or 0
    parts = max(1, math.ceil(size * 2 / index_bytes)) if size > index_bytes else 1
    sc = docs.sparkSession.sparkContext
    hits = HITS.format(known.schema["i"].dataType.simpleString())
    out = docs.withColumn("leaks", F.array().cast(hits))
    for k in range(parts):
        part = known.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k)
        index = sc.broadcast(Index([(r.i, r.t) for r in part.collect()], share, similarity, least))

        def run(texts: list[str | None], index=index) -> list[list]:
            x = index.value
            return [[[{"item_id": h.item, "first_word": i, "score": h.score, "overlap": h.overlap, "question": h.question,
                       "answer": h.answer} for i, _, h in x.hits(t)] for t in texts]]

        out = annotate(out.withColumn("_llm_text", c(text_col)), "_llm_text", f"_llm_leaks {hits}", run)
        out = out.withColumn("leaks", F.concat("leaks", "_llm_leaks")).drop("_llm_leaks")
    return out


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row for each document and item it gives away: doc_id, item_id, first_word, score, overlap, question, answer."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return marked(rows, items, **kw).select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*")
