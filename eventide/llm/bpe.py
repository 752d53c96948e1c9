"""Byte-level BPE by a tokenisation automaton: merges compiled to a transition table, words encoded by its transitions.

Every merge (u, v) adds a gadget to the automaton of correct tokenisations: after the arc ``u`` the arc ``v`` is taken
away, and an arc ``uv`` is laid from wherever ``u`` was open to a copy of the state behind ``v``.  So a state is its last
token; a new token takes the closed arcs of its right part as they stand then, and is itself closed where its left part is.

Copies of copies nest: the states that take over what merge k closes behind ``u`` are those whose right edge meets ``u`` by
tokens made after k.  In an order of tokens by their right edges they stand together, as the arcs do in an order by left
edges.  A merge thus closes one rectangle of (state, arc), and the automaton is the union of all merges' rectangles.  Equal
rows are one state and equal columns one kind of arc; what is left is a table of bits that is read and never searched.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from eventide.llm.common import annotate

# The pre-splitting pattern of byte-level tokenizer files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 1 << 17  # words whose tokens a worker remembers, twice: the latest, and those before them
BAND = 512  # rows of the table that are painted at a time


def byte_letters() -> dict[str, int]:
    """Letter to byte in tokenizer files: printable Latin-1 stands for itself, the other bytes follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Edge:
    """Tokens in an order where those that have another at their edge stand together, the newest first.

    ``inner`` is each token's part on that edge (-1: none), ``order`` all tokens as they were made.
    """

    def __init__(self, inner: list[int], made: list[int], order: list[int]):
        self.start, self.size = [0] * len(inner), [1] * len(inner)
        self.around: dict[int, list[int]] = {}
        self.made = made
        for t in order:
            if inner[t] >= 0:
                self.around.setdefault(inner[t], []).append(t)
        for t in reversed(order):
            if inner[t] >= 0:
                self.size[inner[t]] += self.size[t]
        at = 0
        for t in order:
            if inner[t] < 0:
                self.start[t], at = at, at + self.size[t]
            to = self.start[t] + 1
            for c in reversed(self.around.get(t, [])):
                self.start[c], to = to, to + self.size[c]

    def span(self, t: int, since: int) -> tuple[int, int]:
        """The places of ``t`` and of all tokens that got it at their edge by a merge at ``since`` or later."""
        around = self.around.get(t, [])
        k = bisect_left(around, since, key=self.made.__getitem__)
        return self.start[t], self.start[c] + self.size[c] if k < len(around) and (c := around[k]) >= 0 else self.start[t] + 1


def painted(rects: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Row class of each of ``n`` places, column class of each, and for each column class the bits of row classes.

    ``rects`` has rows of (from row, to row, from column, to column).  Row class 0 has no bit set.  Places that no
    rectangle's border parts are painted once.
    """
    tops, lefts = np.unique([0, *rects[:, 0], *rects[:, 1]]), np.unique([0, *rects[:, 2], *rects[:, 3]])
    r = np.searchsorted(tops, rects[:, :2])
    c = np.searchsorted(lefts, rects[:, 2:])
    kinds: dict[bytes, int] = {bytes(-(-len(lefts) // 8)): 0}
    row_class = np.zeros(len(tops), np.int32)
    for lo in range(0, len(tops), BAND):
        band = np.zeros((min(BAND, len(tops) - lo), len(lefts)), bool)
        here = np.flatnonzero((r[:, 0] < lo + BAND) & (r[:, 1] > lo))
        for (r0, r1), (c0, c1) in zip((r[here] - lo).tolist(), c[here].tolist(), strict=True):
            band[max(r0, 0) : r1, c0:c1] = True
        row_class[lo : lo + BAND] = [kinds.setdefault(x.tobytes(), len(kinds)) for x in np.packbits(band, axis=1)]
    rows = np.frombuffer(b"".join(kinds), np.uint8).reshape(len(kinds), -1)
    kinds.clear()
    column_class = []
    for lo in range(0, rows.shape[1], BAND // 8):
        block = np.unpackbits(rows[:, lo : lo + BAND // 8], axis=1)
        column_class += [kinds.setdefault(x.tobytes(), len(kinds)) for x in np.packbits(block.T, axis=1, bitorder="little")]
    places = np.arange(n)
    return (row_class[np.searchsorted(tops, places, "right") - 1],
            np.array(column_class)[np.searchsorted(lefts, places, "right") - 1], list(kinds))


class Automaton:
    """Tables of the automaton.

    ``state[t]`` is where arc ``t`` leads; ``closed[t]`` has a bit for each state from which arc ``t`` is gone (arcs of one
    kind share it).  State 0 is the start, all arcs open.  ``root`` is a byte trie of the arc labels: byte -> next node, the
    arc whose label ends there, and its closed states (all, where none ends).
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int] | None = None):
        letters = byte_letters()
        size = max([*vocab.values(), *(special or {}).values()], default=-1) + 1
        self.bytes_of: list[bytes] = [b""] * size
        left, right, made = [-1] * size, [-1] * size, [0] * size
        joined: dict[tuple[int, int], int] = {}  # (u, v) -> place of the merge
        for s, i in vocab.items():
            if len(s) == 1 and s in letters:
                self.bytes_of[i] = bytes([letters[s]])
        order = [i for i in range(size) if self.bytes_of[i]]

        def open_at(x: int, y: int, limit: int) -> bool:
            """Whether arc ``y`` is open after arc ``x`` when the merges before ``limit`` have been added."""
            while True:
                if joined.get((x, y), limit) < limit:
                    return False
                if made[x] > made[y]:  # before the left token was complete, its right part stood here
                    limit, x = made[x], right[x]
                elif made[y]:  # equal merges go from left to right, so one in the same step comes first
                    limit, y = made[y] + 1, left[y]
                else:
                    return True

        for k, (a, b) in enumerate(merges, 1):  # one gadget for each merge, in order
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            # Where v cannot follow u at this step, there is no path to shorten and no arc comes of the merge.
            if (u, v) in joined or not self.bytes_of[u] or not self.bytes_of[v] or not open_at(u, v, k):
                continue
            joined[u, v] = k
            if not self.bytes_of[w]:
                left[w], right[w], made[w] = u, v, k
                self.bytes_of[w] = self.bytes_of[u] + self.bytes_of[v]
                order.append(w)
        states, arcs = Edge(right, made, order), Edge(left, made, order)
        # The state of a merge's own token is copied before the arc goes, its arc after.
        rects = [(*states.span(u, k + 1), *arcs.span(v, k)) for (u, v), k in joined.items()]
        row, column, bits = painted(np.array(rects, np.int64).reshape(-1, 4), len(order))
        self.state, self.closed = [0] * size, [b""] * size
        for t in order:
            self.state[t], self.closed[t] = int(row[states.start[t]]), bits[column[arcs.start[t]]]
        self.nodes: list[dict[int, list]] = [{}]
        none = b"\xff" * len(bits[0]) if bits else b"\xff"
        for i in order:
            node = self.nodes[0]
            for x in self.bytes_of[i]:
                if x not in node:
                    self.nodes.append({})
                    node[x] = [self.nodes[-1], -1, none]
                at = node[x]
                node = at[0]
            at[1:] = i, self.closed[i]
        self.nodes.reverse()  # inner nodes first, so that pickling doesn't go down the trie
        self.root = self.nodes[-1]
        self.special = special or {}
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.longest = max(map(len, self.bytes_of), default=1)
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    @classmethod
    def load(cls, text: str) -> Automaton:
        """From the JSON text of a tokenizer file with a byte-level BPE model."""
        j = json.loads(text)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in j["model"]["merges"]]
        return cls(j["model"]["vocab"], merges, {t["content"]: t["id"] for t in j.get("added_tokens", [])})

    def follows(self, a: int, b: int) -> bool:
        """Whether arc ``b`` is open in the state behind arc ``a``."""
        s = self.state[a]
        return not self.closed[b][s >> 3] >> (s & 7) & 1

    def word(self, word: bytes) -> tuple[int, ...]:
        """Labels of the one accepted path that spells ``word``.

        Goes through the word's places once; every place is reached by one arc at most, since each beginning of the word
        has one tokenisation, and its state is that arc's.  Steps are bounded by the word's length times the longest label,
        and 4 bytes are kept for each place.
        """
        n, root, state = len(word), self.root, self.state
        came = array("i", [-1]) * (n + 1)  # the arc that leads to each place
        for at in range(n):
            if at and came[at] < 0:
                continue
            s = state[came[at]] if at else 0
            block, bit, node, to = s >> 3, 1 << (s & 7), root, at
            for byte in word[at:] if n - at < 64 else word[at : at + self.longest]:
                if (hit := node.get(byte)) is None:
                    break
                node, token, gone = hit
                to += 1
                if not gone[block] & bit:
                    came[to] = token
            if came[n] >= 0:
                break
        path, size_of = [], self.bytes_of
        while n:
            if came[n] < 0:
                raise ValueError("a byte has no token")
            path.append(came[n])
            n -= len(size_of[came[n]])
        return tuple(reversed(path))

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; strings of added tokens are those tokens."""
        out: list[int] = []
        known = self.words
        for piece in self._split(text):
            if piece in self.special:
                out.append(self.special[piece])
                continue
            for w in _pattern().findall(piece):
                ids = known.get(w)
                if ids is None:
                    if len(known) >= CACHE:
                        self.older, known = known, {}
                        self.words = known
                    ids = known[w] = self.older.get(w) or self.word(w.encode("utf-8", "surrogatepass"))
                out += ids
        return out

    def _split(self, text: str) -> list[str]:
        if not any(s in text for s in self.special):
            return [text]
        marks = sorted(self.special, key=len, reverse=True)
        return [p for p in regex.split("(" + "|".join(map(regex.escape, marks)) + ")", text) if p]

    def decode(self, ids: list[int]) -> str:
        """Emits the labels of the arcs; bytes that are no UTF-8 become the replacement character."""
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(1)
def _pattern() -> regex.Pattern:
    return regex.compile(PATTERN)


@lru_cache(2)
def automaton(text: str) -> Automaton:
    """The compiled automaton of a tokenizer file's text; the driver compiles it once and broadcasts its tables."""
    return Automaton.load(text)


def _text(path: str) -> str:
    with open(path, encoding="utf-8") as f:  # a parameter's file, beside the driver's program
        return f.read()


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def round_trip(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens, ids (little-endian unsigned 32-bit integers) and decoded in place of the text.

    ``tokenizer`` is the path of a tokenizer file on the driver; its automaton, some 20 MB for 50,000 tokens, is broadcast.  Null and empty texts have
    no ids and decode to an empty text.  Texts of any length are encoded whole.  Repeated rows give equal ids; other
    columns pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automaton(_text(tokenizer)))

    def run(texts: list[str | None]) -> list[list]:
        a = shared.value
        ids = [a.encode(t or "") for t in texts]
        return [[len(i) for i in ids], [_packed(i) for i in ids], [a.decode(i) for i in ids]]

    return annotate(docs, text_col, "n_tokens long, ids binary, decoded string", run, 64)


def encoded(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """As :func:`round_trip`, without decoded."""
    return round_trip(docs, tokenizer, text_col).drop("decoded")


def decoded(docs: DataFrame, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``text`` in place of ids as :func:`round_trip` packs them; null ids give an empty text."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton(_text(tokenizer)))

    def run(rows: list[bytes | None]) -> list[list]:
        a = shared.value
        return [[a.decode(np.frombuffer(ids or b"", "<u4").tolist()) for ids in rows]]

    return annotate(docs, ids_col, "text string", run, 64)
