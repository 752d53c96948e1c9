"""Exact removal of repeated passages: longest-previous-factor arrays over suffix arrays.

A byte goes if a string of ``length`` bytes around it also starts in a document with a smaller id.  Such strings meet
through content-defined anchors: of the shorter strings inside a window of ``length`` bytes, the one with the least hash
is its anchor.  Equal windows have equal anchors at equal places, so only windows whose anchor occurs in two documents
can repeat, and only their surroundings travel, dealt by the anchor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from eventide.llm.common import blocked, pack, stage, unpack

LENGTH = 50
GRAM = 20
_M = 0x9E3779B97F4A7C15
_PLACE = 24  # bits of a place inside a piece; the other bits order the hashes
_PIECE = 1 << 22


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_M, n, 1 << 64))


def _joined(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Hashes of runs of n bytes and what follows them."""
    m = len(right) - n
    return left[:m] + _power(n) * right[n:] if m > 0 else np.empty(0, np.uint64)


def gram_hashes(b: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` bytes: doubling, then the parts that make up the length."""
    with np.errstate(over="ignore"):
        part, n, out, done = b.astype(np.uint64) + np.uint64(1), 1, None, 0
        while True:
            if length & n:
                out, done = (part, n) if out is None else (_joined(out, part, done), done + n)
            if n * 2 > length:
                break
            part, n = _joined(part, part, n), n * 2
        return out[: max(len(b) - length + 1, 0)]


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def window_anchors(b: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the anchor of every window of ``length`` bytes; the leftmost of equal hashes."""
    n = len(b) - length + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    wide = length - gram + 1
    places, hashes = [], []
    for i in range(0, n, _PIECE):
        h = mixed(gram_hashes(b[i : i + _PIECE + length - 1], gram))
        low = np.uint64((1 << _PLACE) - 1)
        v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while span * 2 <= wide:
            v = np.minimum(v[: len(v) - span], v[span:])
            span *= 2
        if span < wide:
            v = np.minimum(v[: len(v) - (wide - span)], v[wide - span :])
        at = (v & low).astype(np.int64)
        hashes.append(h[at])
        places.append(at + i)
    return np.concatenate(places), np.concatenate(hashes)


def suffix_order(text: np.ndarray, starts: np.ndarray, owner: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` from ``starts`` in the order of their first ``length`` bytes, then of ``owner``.

    Sorted eight bytes at a time; only suffixes whose place is not settled go on (a suffix alone in its group shares less
    than ``length`` bytes with all others and is left out).  Returns the places in ``starts``, and for each whether it
    shares ``length`` bytes or more with the one before it: the longest-common-prefix array, cut at ``length``.
    """
    at = np.arange(len(starts))
    group = np.zeros(len(at), np.int64)
    for off in sorted({*range(0, length - 7, 8), max(length - 8, 0)}):
        key = np.zeros(len(at), np.uint64)
        for k in range(min(8, length)):
            key = (key << np.uint64(8)) | text[starts[at] + off + k]
        order = np.lexsort((key, group)) if off else np.argsort(key, kind="stable")
        at, key, group = at[order], key[order], group[order]
        new = np.ones(len(at), bool)
        new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        alone = new & np.append(new[1:], True)
        at, new = at[~alone], new[~alone]
        group = np.cumsum(new)
        if not len(at):
            break
    order = np.lexsort((owner[at], group[: len(at)]))
    same = np.zeros(len(at), bool)
    same[1:] = group[1 : len(at)] == group[: len(at) - 1] if len(at) else same[1:]
    return at[order], same


def has_earlier(owner: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Whether the longest previous factor of each suffix reaches the length, for suffixes in order.

    The nearest suffix before and the nearest after with a smaller owner share the most with it of all that have one;
    both are found by pointer jumping: while a pointer's owner is no smaller, it takes that one's pointer.
    """
    def smaller(owner: np.ndarray, same: np.ndarray) -> np.ndarray:
        to = np.where(same, np.arange(len(owner)) - 1, -1)  # -1: less than the length is shared from there on
        while True:
            bad = np.flatnonzero((to >= 0) & (owner[to] >= owner))
            if not len(bad):
                return to >= 0
            to[bad] = to[to[bad]]

    before = smaller(owner, same)
    after = smaller(owner[::-1], np.append(same[1:], False)[::-1])[::-1]
    return before | after


class Block:
    """The windows of a block's documents, in stretches with one anchor."""

    def __init__(self, ids: list[int | None], texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
        self.length = length
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum([len(t) for t in texts])
        self.starts = self.ends - [len(t) for t in texts]
        place, hashes = window_anchors(self.bytes, length, gram)
        row = np.repeat(np.arange(len(texts)), self.ends - self.starts)[: len(place)]
        known = np.array([i is not None for i in ids], bool)
        at = np.flatnonzero((np.arange(len(place)) + length <= self.ends[row]) & known[row]) if len(place) else np.empty(0, np.int64)
        place = place[at]
        new = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(at) else np.empty(0, np.int64)
        self.first = at[new]  # first window of each stretch
        self.count = np.diff(np.append(new, len(at))).astype(np.int64)
        self.anchor = hashes[self.first] & np.uint64((1 << 48) - 1)
        self.owner = np.array([0 if i is None else i for i in ids], np.int64)[row[self.first]] if len(new) else np.empty(0, np.int64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors, and what is known of each: times seen, up to 127, plus 128 if in two documents."""
        keys, at, times = np.unique(self.anchor, return_inverse=True, return_counts=True)
        least, most = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), np.iinfo(np.int64).min)
        np.minimum.at(least, at, self.owner)
        np.maximum.at(most, at, self.owner)
        return keys, (np.minimum(times, 127) + 128 * (least != most)).astype(np.uint8)

    def passages(self, code: np.ndarray) -> dict[str, np.ndarray]:
        """Distinct passages around repeated anchors: where each starts, how many windows it has, its key and least owner.

        ``code`` is by distinct anchor: 0 alone, 1 repeated (a passage is a whole stretch), 2 very often (a passage is a
        single window, so that what only some of its surroundings share is dealt out).  ``of`` is the passage of each
        stretch or window, ``window`` its first window, ``windows`` their number, ``mine`` its document.
        """
        keys, at = np.unique(self.anchor, return_inverse=True)
        c = code[at] if len(at) else np.empty(0, np.uint8)
        whole, single = np.flatnonzero(c == 1), np.flatnonzero(c == 2)
        n = self.count[single]
        each = np.repeat(single, n)
        step = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        window = np.concatenate((self.first[whole], self.first[each] + step))
        windows = np.concatenate((self.count[whole], np.ones(len(each), np.int64)))
        mine = np.concatenate((self.owner[whole], self.owner[each]))
        h = gram_hashes(self.bytes, self.length)
        key = mixed(h[window] ^ mixed(h[window + windows - 1] + windows.astype(np.uint64)))
        route = np.concatenate((self.anchor[whole], mixed(h[window[len(whole):]])))
        order = np.lexsort((mine, key))
        new = np.ones(len(order), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        head = order[new]
        return {"window": window, "windows": windows, "mine": mine, "of": of, "at": window[head], "n": windows[head],
                "least": mine[head], "route": route[head]}

    def cut(self, p: dict[str, np.ndarray], mask: np.ndarray) -> np.ndarray:
        """Which bytes go, given each distinct passage's windows (bits) that start in a smaller document than its least."""
        gone = np.zeros(len(self.bytes) + 1, np.int32)
        later = p["mine"] > p["least"][p["of"]] if len(p["of"]) else np.empty(0, bool)
        bits = np.where(later, np.uint64((1 << 63) - 1), mask[p["of"]] if len(p["of"]) else np.empty(0, np.uint64))
        for k in range(int(p["windows"].max(initial=0))):
            hit = (k < p["windows"]) & ((bits >> np.uint64(k)) & np.uint64(1)).astype(bool)
            w = p["window"][hit] + k
            np.add.at(gone, w, 1)
            np.add.at(gone, w + self.length, -1)
        return np.cumsum(gone[:-1]) > 0


def earlier_windows(text: np.ndarray, n: np.ndarray, least: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each passage the windows (bits) that also start in a passage of a smaller owner; passages of one anchor shard.

    Equal passages count as one of the least owner: all windows of the others are repeats.
    """
    size = n + length - 1
    end = np.cumsum(size)
    start = end - size
    h = gram_hashes(text, length)
    key = mixed(h[start] ^ mixed(h[start + n - 1] + n.astype(np.uint64)))
    order = np.lexsort((least, key))
    new = np.ones(len(order), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    head = order[new]
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    each = np.repeat(np.arange(len(head)), n[head])
    step = np.arange(len(each)) - np.repeat(np.cumsum(n[head]) - n[head], n[head])
    starts, owner = start[head][each] + step, least[head][each]
    at, same = suffix_order(text, starts, owner, length)
    hit = at[has_earlier(owner[at], same)]
    mask = np.zeros(len(head), np.uint64)
    np.bitwise_or.at(mask, each[hit], np.uint64(1) << step[hit].astype(np.uint64))
    return np.where(least > least[head][of], np.uint64((1 << 63) - 1), mask[of])


BLOCK_BYTES = 3 << 20
SHARD_BYTES = 8 << 20  # of text, whose anchors make one shard
HOT = 2000  # an anchor seen more often is dealt out by single windows
_DEALT = StructType().add("shard", "long").add("block", "long").add("body", "binary")
_TOLD = StructType().add("block", "long").add("kind", "integer").add("shard", "long").add("body", "binary")


def _column(t: pa.Table, name: str) -> list:
    return t.column(name).to_pylist()


def _of_block(t: pa.Table, length: int, gram: int) -> tuple[pa.Table, Block]:
    t = t.sort_by("row")
    return t, Block(_column(t, "id"), [x.encode("utf-8", "surrogatepass") for x in _column(t, "text")], length, gram)


def _rows(schema: StructType, rows: list[tuple]) -> pa.Table:
    s = to_arrow_schema(schema)
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(s)], schema=s)


def _deal(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by shard, and where each begins."""
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(key) % np.uint64(shards)).astype(np.int64)


def _answers(told: pa.Table, kind: int, shard: np.ndarray, dtype: str) -> np.ndarray:
    """A block's answers of one kind, put back into the order of its questions."""
    out = np.zeros(len(shard), dtype)
    if len(shard):
        order = np.argsort(shard, kind="stable")
        rows = [r for r in told.select(["kind", "shard", "body"]).to_pylist() if r["kind"] == kind]
        parts = [unpack(r["body"])[0] for r in sorted(rows, key=lambda r: r["shard"])]
        out[order] = np.concatenate(parts)
    return out


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", others: tuple[str, ...] = (), length: int = LENGTH,
    gram: int = GRAM, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES, hot: int = HOT, as_text: bool = False,
) -> DataFrame:
    """One row for each row of ``docs``: id, kept (binary), n_bytes, n_removed, spans, rest (struct of ``others``).

    Every byte of a text in UTF-8 goes that is covered by a string of ``length`` bytes which also starts in a document
    with a smaller id, judged on the input; ``spans`` are the removed runs (start, length).  Null texts are empty; shorter
    texts lose nothing.  Rows that share an id are one document: none is earlier than another.  A null id is in no order:
    its row loses nothing and takes nothing from others.  No rows give no rows.  With ``as_text`` kept is a string,
    without the bytes of characters that a cut has split.

    Texts lie still in blocks.  Per shard of anchors one task learns which anchors are in two documents, then sorts the
    suffixes of the passages around those, each distinct passage of a block once.  An anchor seen over ``hot`` times sends
    single windows instead, dealt by their content, of which a block sends each once: no shard grows with a frequent
    passage.  Runs jobs when called.
    """
    blocks = blocked(docs, id_col, text_col, block_bytes, others=others)
    n = blocks.agg(F.count_distinct("block")).first()[0]
    shards = max(1, -(-n * block_bytes // shard_bytes))

    def ask(t: pa.Table) -> pa.Table:
        _, b = _of_block(t, length, gram)
        keys, seen = b.anchors()
        order, edge = _deal(_shard_of(keys, shards), shards)
        block = t.column("block")[0].as_py()
        out = []
        for s in np.flatnonzero(np.diff(edge)).tolist():
            o = order[edge[s] : edge[s + 1]]
            k = keys[o]
            low, high = (k & np.uint64(0xFFFFFFFF)).astype(np.uint32), (k >> np.uint64(32)).astype(np.uint16)
            out.append((s, block, pack(low, high, seen[o])))
        return _rows(_DEALT, out)

    def count(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["block"])
        parts = [unpack(r["body"]) for r in rows]
        key = np.concatenate([low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32)) for low, high, _ in parts])
        seen = np.concatenate([x for *_, x in parts])
        _, at, blocks_ = np.unique(key, return_inverse=True, return_counts=True)
        times = np.bincount(at, seen & 127)
        two = np.bincount(at, seen >> 7) > 0
        code = np.where(two | (blocks_ > 1), np.where(times > hot, 2, 1), 0).astype(np.uint8)[at]
        edge = np.cumsum([0, *(len(p[0]) for p in parts)])
        return _rows(_TOLD, [(r["block"], 0, r["shard"], pack(code[a:z])) for r, a, z in zip(rows, edge, edge[1:], strict=False)])

    def send(t: pa.Table, told: pa.Table) -> pa.Table:
        if not t.num_rows or not told.num_rows:
            return _rows(_DEALT, [])
        _, b = _of_block(t, length, gram)
        p = b.passages(_answers(told, 0, _shard_of(b.anchors()[0], shards), "u1"))
        order, edge = _deal(_shard_of(p["route"], shards), shards)
        block = t.column("block")[0].as_py()
        out = []
        for s in np.flatnonzero(np.diff(edge)).tolist():
            o = order[edge[s] : edge[s + 1]]
            size = p["n"][o] + length - 1
            each = np.repeat(p["at"][o] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            out.append((s, block, pack(p["n"][o].astype(np.uint8), p["least"][o], b.bytes[each])))
        return _rows(_DEALT, out)

    def sort(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["block"])
        parts = [unpack(r["body"]) for r in rows]
        size = np.concatenate([x for x, _, _ in parts]).astype(np.int64)
        mask = earlier_windows(np.concatenate([x for *_, x in parts]), size, np.concatenate([x for _, x, _ in parts]), length)
        edge = np.cumsum([0, *(len(p[0]) for p in parts)])
        return _rows(_TOLD, [(r["block"], 1, r["shard"], pack(mask[a:z])) for r, a, z in zip(rows, edge, edge[1:], strict=False)])

    result = StructType.fromDDL(
        f"id long, kept {'string' if as_text else 'binary'}, n_bytes long, n_removed long, spans array<struct<start:bigint,length:bigint>>"
    ).add("rest", blocks.schema["rest"].dataType)

    def finish(t: pa.Table, told: pa.Table) -> pa.Table:
        t, b = _of_block(t, length, gram)
        p = b.passages(_answers(told, 0, _shard_of(b.anchors()[0], shards), "u1"))
        gone = b.cut(p, _answers(told, 1, _shard_of(p["route"], shards), "u8"))
        rows = []
        for i, a, z, x in zip(_column(t, "id"), b.starts.tolist(), b.ends.tolist(), _column(t, "rest"), strict=True):
            g = gone[a:z]
            edges = np.flatnonzero(np.diff(np.concatenate(([False], g, [False])).astype(np.int8))).tolist()
            spans = [{"start": s, "length": e - s} for s, e in zip(edges[::2], edges[1::2], strict=True)]
            kept = b.bytes[a:z][~g].tobytes()
            rows.append((i, kept.decode("utf-8", "ignore") if as_text else kept, z - a, int(g.sum()), spans, x))
        return _rows(result, rows)

    by_block, told = blocks.groupBy("block"), None
    told = stage(by_block.applyInArrow(ask, _DEALT).groupBy("shard").applyInArrow(count, _TOLD))
    sent = by_block.cogroup(told.groupBy("block")).applyInArrow(send, _DEALT)
    masks = stage(sent.groupBy("shard").applyInArrow(sort, _TOLD))
    return by_block.cogroup(told.unionByName(masks).groupBy("block")).applyInArrow(finish, result)
