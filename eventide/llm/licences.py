r"""Licence scans: a generalised suffix automaton of licence texts, matching statistics, chains of long matches.

A text's words are followed through the automaton: at every word it gives the longest run of words ending there that stands in
some template (the matching statistic), and which templates have it.  Runs that cannot be made longer are anchors; anchors
that stand in the same order in text and template, with small gaps, chain to spans.  A span's share is the part of the
template's words that its anchors cover.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from eventide.llm.common import annotate
from eventide.llm.licence_texts import PHRASES, TEMPLATES

LEAST = 3  # words of an anchor
GAP = 24  # words between two anchors of a chain, in text and template
SHARE = 0.8  # of a template's words that a span must cover to give its label
PIECE = 1 << 20  # bytes cut into words at a time

# Words are runs of 0-9, a-z (A-Z lower-cased) and everything beyond ASCII; all else becomes a space.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def pieces(text: str | None):
    """Lists of a text's words as UTF-8, of about ``PIECE`` bytes of text each."""
    b = text.encode("utf-8", "surrogatepass").translate(_FOLD) if text else b""
    at = 0
    while at < len(b):
        end = b.find(b" ", at + PIECE)
        end = len(b) if end < 0 else end
        yield b[at:end].split()
        at = end


def words(text: str | None) -> list[bytes]:
    return [w for p in pieces(text) for w in p]


@dataclass
class Automaton:
    """Suffix automaton of several word sequences; state 0 stands for the empty run.

    A state stands for the runs of words that end at the same places: the longest has ``length`` words, its ``link`` is the
    state of the longest run that ends at more places.
    """

    vocabulary: dict[bytes, int]
    steps: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])  # (sequence, words up to the end)

    def _state(self, length: int, steps: dict[int, int], link: int) -> int:
        self.steps.append(steps)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.steps) - 1

    def _split(self, p: int, w: int) -> int:
        """The state of the run of ``length[p] + 1`` words that ends the step from p by w, cut out of a longer one if need be."""
        q = self.steps[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, dict(self.steps[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.steps[p].get(w) == q:
            self.steps[p][w] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: list[int], number: int) -> None:
        last = 0
        for n, w in enumerate(sequence, 1):
            if w in self.steps[last]:  # another sequence begins alike
                last = self._split(last, w)
            else:
                new, p = self._state(self.length[last] + 1, {}, 0), last
                while p >= 0 and w not in self.steps[p]:
                    self.steps[p][w] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, w)
                last = new
            self.ends[last].append((number, n))

    def close(self) -> None:
        """Every end of a run is an end of its shorter suffixes."""
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.ends[self.link[v]] += self.ends[v]

    def step(self, state: int, run: int, w: int) -> tuple[int, int]:
        """State and length of the longest run after one more word."""
        while state and w not in self.steps[state]:
            state = self.link[state]
            run = self.length[state]
        return (self.steps[state][w], run + 1) if w in self.steps[state] else (0, 0)


class Scanner:
    """Automaton of templates and phrases with what :meth:`scan` looks up in each state."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.labels = [label for label, _ in (*phrases, *templates)]
        self.n_phrases = len(phrases)
        sequences = [words(text) for _, text in (*phrases, *templates)]
        self.sizes = [len(s) for s in sequences]
        self.vocabulary: dict[bytes, int] = {}
        for s in sequences:
            for w in s:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)  # 0: a word of no template
        a = self.automaton = Automaton(self.vocabulary)
        ids = [[self.vocabulary[w] for w in s] for s in sequences]
        for k, s in enumerate(ids):
            a.add(s, k)
        a.close()
        self.pairs = np.zeros((len(self.vocabulary) + 1,) * 2, bool)  # of neighbouring words in some template
        for s in ids:
            self.pairs[s[:-1], s[1:]] = True
        # Of each state: the longest run, up to the state's own, that stands in a template, with its ends there; whole phrases.
        self.best: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]
        self.whole: list[tuple[tuple[int, int], ...]] = [()]
        above = sorted(range(1, len(a.link)), key=a.length.__getitem__)
        self.best += [{} for _ in above]
        self.whole += [() for _ in above]
        for v in above:
            mine: dict[int, list[int]] = defaultdict(list)
            for k, end in a.ends[v]:
                mine[k].append(end)
            best = dict(self.best[a.link[v]])
            best.update({k: (a.length[v], tuple(sorted(set(e)))) for k, e in mine.items() if k >= self.n_phrases})
            self.best[v] = {k: x for k, x in best.items() if x[0] >= LEAST}
            shortest = a.length[a.link[v]] + 1
            here = tuple((k, self.sizes[k]) for k in mine if k < self.n_phrases and self.sizes[k] in mine[k]
                         and shortest <= self.sizes[k] <= a.length[v])
            self.whole[v] = self.whole[a.link[v]] + here

    def identifiers(self, text: str | None) -> np.ndarray:
        get = self.vocabulary.get
        parts = [np.fromiter((get(w, 0) for w in p), np.int32, len(p)) for p in pieces(text)]
        return np.concatenate(parts) if parts else np.empty(0, np.int32)

    def runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Stretches (first word, one past the last) of two words or more in which all neighbours are neighbours in a template.

        No match of two words or more leaves such a stretch, so the automaton has nothing to do outside.
        """
        near = np.zeros(len(ids) + 1, np.int8)
        near[1:-1] = self.pairs[ids[:-1], ids[1:]] if len(ids) > 1 else 0
        edge = np.diff(near)
        return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) + 1).tolist(), strict=True))

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[tuple[str, int, int, int, float]]]:
        """Number of words, places (phrase, first word) and spans (label, first word, words, covered words, share) of a text."""
        ids = self.identifiers(text)
        places: list[tuple[int, int]] = []
        anchors: dict[int, list[tuple[int, int, tuple[int, ...]]]] = defaultdict(list)  # template: (end, length, ends there)
        for start, stop in self.runs(ids):
            state = run = 0
            open_runs: dict[int, tuple[int, tuple[int, ...]]] = {}
            for i, w in enumerate(ids[start:stop].tolist(), start):
                state, run = self.automaton.step(state, run, w)
                places += [(k, i + 1 - n) for k, n in self.whole[state] if n <= run]
                now = {k: (min(n, run), e) for k, (n, e) in self.best[state].items() if min(n, run) >= LEAST}
                for k, (n, e) in open_runs.items():
                    if now.get(k, (0,))[0] != n + 1:
                        anchors[k].append((i, n, e))
                open_runs = now
            for k, (n, e) in open_runs.items():
                anchors[k].append((stop, n, e))
        spans = [s for k in sorted(anchors) for s in self._spans(k, anchors[k])]
        return len(ids), places, spans

    def _spans(self, template: int, anchors: list[tuple[int, int, tuple[int, ...]]]):
        """Best chain from each first anchor; of overlapping ones of one template that which covers most."""
        links: list[tuple[int, int, int, int]] = []  # text end, template end, covered, first word
        best: dict[int, tuple[int, int]] = {}  # first word: covered, text end
        low = 0
        for end, n, places in anchors:
            while low < len(links) and links[low][0] < end - n - GAP:
                low += 1
            found = []
            for at in places:
                covered, first = n, end - n
                for e, p, c, f in links[low:]:
                    over = max(0, e - (end - n), p - (at - n))
                    if e < end and p < at and at - n - p <= GAP and over < n and (c + n - over, -f) > (covered, -first):
                        covered, first = c + n - over, f
                found.append((end, at, covered, first))
                best[first] = max(best.get(first, (0, 0)), (covered, end))
            links += found
        taken: list[tuple[int, int]] = []
        for first, (covered, end) in sorted(best.items(), key=lambda x: (-x[1][0], x[0])):
            k = bisect_left(taken, (first, end))
            if (k == 0 or taken[k - 1][1] <= first) and (k == len(taken) or taken[k][0] >= end):
                taken.insert(k, (first, end))
                yield self.labels[template], first, end - first, covered, covered / self.sizes[template]


@lru_cache(maxsize=4)
def scanner(templates=TEMPLATES, phrases=PHRASES) -> Scanner:
    """One for each worker."""
    return Scanner(templates, phrases)


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES, share: float = SHARE
) -> DataFrame:
    """Licences of whole texts: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``n_base`` counts the places of ``phrases`` (label, words), overlapping ones too; first_word and last_word are the smallest
    and largest start of a place, counted from 0, null without any.  base_labels are the labels of these places, labels also
    those of spans that cover at least ``share`` of a template; distinct, sorted, comma-joined, empty if there are none.  score is the
    greatest share of a template or phrase that the text covers.  spans (label, first_word, n_words, covered, share) has all
    spans, those below ``share`` included.  A null or empty text has no words; ids are carried as they are, null or repeated;
    columns other than id and text are ignored, whatever their names.  A text is read in pieces; four bytes a word are held.
    """
    out = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
           "spans array<struct<label:string,first_word:long,n_words:long,covered:long,share:double>>")
    names = ("label", "first_word", "n_words", "covered", "share")

    def run(texts: list[str | None]) -> list[list]:
        s = scanner(templates, phrases)
        rows = []
        for text in texts:
            n, places, spans = s.scan(text)
            starts = [i for _, i in places]
            base = {s.labels[k] for k, _ in places}
            all_labels = base | {x[0] for x in spans if x[4] >= share}
            score = 1.0 if places else max((x[4] for x in spans), default=0.0)
            rows.append((
                n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                ",".join(sorted(all_labels)), score, [dict(zip(names, x, strict=True)) for x in spans],
            ))
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(8)]

    return annotate(docs.select(id_col, text_col), text_col, out, run)
