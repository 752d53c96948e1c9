"""Elias-Fano n-gram trie: two levels of monotone sequences with quantised probabilities, in one mappable buffer."""

from __future__ import annotations

import json
import mmap

import numpy as np

STEP = 1 / 2048  # of quantised log10 values
CHILD_BITS = 40


def quantised(log10: np.ndarray) -> np.ndarray:
    """log10 values from -30 to 2 as two bytes."""
    return np.clip(np.rint((2 - np.asarray(log10)) / STEP), 0, 65535).astype("<u2")


def opened(q: np.ndarray) -> np.ndarray:
    return 2 - q.astype(np.float64) * STEP


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary; successor search by the high bits' bucket."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = np.flatnonzero(np.unpackbits(high.view(np.uint8), bitorder="little"))[:n]
        self.tops = (ones - np.arange(n)).astype(np.uint64)  # high parts
        self.bucket = np.searchsorted(self.tops, np.arange(int(self.tops[-1]) + 2 if n else 1, dtype=np.uint64))

    @staticmethod
    def pieces(x: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
        """(length, low bits, packed low bits, unary high bits) of a sorted array of unsigned numbers."""
        n = len(x)
        top = int(x[-1]) + 1 if n else 1
        bits = max((top // max(n, 1)).bit_length() - 1, 0)
        low = np.zeros((n * bits + 63) // 64 + 1, "<u8")
        if bits and n:
            value = x & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, value << off)
            over = off + np.uint64(bits) > 64
            np.bitwise_or.at(low, word[over] + 1, value[over] >> (np.uint64(64) - off[over]))
        ones = (x >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(ones[-1]) // 64 + 1 if n else 1) * 64, np.uint8)
        high[ones] = 1
        return n, bits, low, np.packbits(high, bitorder="little").view("<u8")

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        value = self.low[word] >> off
        over = np.flatnonzero(off + np.uint64(self.low_bits) > 64)
        value[over] |= self.low[word[over] + 1] << (np.uint64(64) - off[over])
        return value & np.uint64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.tops[i] << np.uint64(self.low_bits)) | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Place of the first element that is not less than x, or the length."""
        top = x >> np.uint64(self.low_bits)
        inside = top < len(self.bucket) - 1
        at = np.full(len(x), self.n, np.int64)
        b = top[inside].astype(np.int64)
        at[inside], end = self.bucket[b], np.full(len(x), 0, np.int64)
        end[inside] = self.bucket[b + 1]
        low = x & np.uint64((1 << self.low_bits) - 1)
        todo = np.flatnonzero(at < end)
        while len(todo):  # bisection inside the buckets
            middle = (at[todo] + end[todo]) >> 1
            less = self._low(middle) < low[todo]
            at[todo[less]] = middle[less] + 1
            end[todo[~less]] = middle[~less]
            todo = todo[at[todo] < end[todo]]
        return at


class Trie:
    """Contexts with a back-off weight each, and their children with a probability each.

    Level one holds the contexts' keys; pointers, monotone too, give each context's stretch of level two, which holds the
    children's keys above the rank of their context, so that one sequence serves all contexts and a search is relative to
    its context.  All arrays lie in one buffer: bytes, an anonymous map, or a file that is mapped and shared.
    """

    def __init__(self, buffer):
        view = memoryview(buffer)
        size = int.from_bytes(view[:8], "little")
        head = json.loads(bytes(view[8 : 8 + size]))
        self.parts = {k: np.frombuffer(view, kind, n, at) for k, (kind, n, at) in head["arrays"].items()}
        level = lambda k: EliasFano(*head[k], self.parts[k + "_low"], self.parts[k + "_high"])
        self.contexts, self.pointers, self.children = level("contexts"), level("pointers"), level("children")
        self.weight, self.prob = self.parts["weight"], self.parts["prob"]

    @staticmethod
    def build(contexts: np.ndarray, weight: np.ndarray, counts: np.ndarray, children: np.ndarray, prob: np.ndarray) -> bytes:
        """From sorted distinct context keys with log10 weights, numbers of children, children by context (sorted, under
        2^40) and their log10 probabilities."""
        rank = np.repeat(np.arange(len(contexts), dtype=np.uint64), counts)
        levels = {"contexts": contexts.astype(np.uint64), "pointers": np.append(0, np.cumsum(counts)).astype(np.uint64),
                  "children": (rank << np.uint64(CHILD_BITS)) | children.astype(np.uint64)}
        head: dict = {"arrays": {}}
        arrays = {}
        for k, x in levels.items():
            n, bits, low, high = EliasFano.pieces(x)
            head[k] = [n, bits]
            arrays[k + "_low"], arrays[k + "_high"] = low, high
        arrays["weight"], arrays["prob"] = quantised(weight), quantised(prob)
        at, blobs = 0, []
        for k, a in arrays.items():
            head["arrays"][k] = [a.dtype.str, len(a), at]
            blobs.append(a.tobytes() + bytes(-a.nbytes % 8))
            at += len(blobs[-1])
        base = 8 + len(json.dumps(head)) + 16 * len(arrays)
        base += -base % 8
        for v in head["arrays"].values():
            v[2] += base
        text = json.dumps(head).encode().ljust(base - 8)
        return len(text).to_bytes(8, "little") + text + b"".join(blobs)

    @classmethod
    def mapped(cls, data: bytes) -> Trie:
        """In an anonymous memory map, without a file."""
        m = mmap.mmap(-1, len(data))
        m.write(data)
        return cls(m)

    @classmethod
    def open(cls, path: str) -> Trie:
        """A file's trie, mapped read-only: processes on a machine share its pages."""
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def log10(self, context: np.ndarray, child: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """log10 p of children after contexts; an unseen child's is the context's weight plus ``lower``, its log10 p alone.

        Unknown contexts leave ``lower`` as it is.
        """
        out = lower.astype(np.float64).copy()
        if not self.contexts.n:
            return out
        r = self.contexts.successor(context.astype(np.uint64))
        r = np.minimum(r, self.contexts.n - 1)
        known = np.flatnonzero(self.contexts.get(r) == context)
        r = r[known]
        first, last = self.pointers.get(r), self.pointers.get(r + 1)
        x = (r.astype(np.uint64) << np.uint64(CHILD_BITS)) | child[known].astype(np.uint64)
        at = self.children.successor(x)
        inside = (at >= first.astype(np.int64)) & (at < last.astype(np.int64))
        hit = np.zeros(len(r), bool)
        hit[inside] = self.children.get(at[inside]) == x[inside]
        out[known] += opened(self.weight[r])
        out[known[hit]] = opened(self.prob[at[hit]])
        return out
