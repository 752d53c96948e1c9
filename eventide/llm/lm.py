"""Language-model scoring: a bigram model of all training texts in sharded Elias-Fano tries.

Texts lie still in blocks.  Each block asks for what it needs once: first its distinct words (counts come back), then its
distinct bigrams.  A shard of bigrams holds whole contexts, adds up all blocks' counts, builds its trie of smoothed
probabilities and answers every question from it.  The context of a very frequent word is split by the following word's
bucket, so no shard grows with a word's frequency, and probabilities still add up to one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from eventide.llm.common import blocked, pack, stage, unpack, words
from eventide.llm.trie import CHILD_BITS, Trie, opened, quantised

BLOCK_BYTES = 4 << 20
SHARD_BYTES = 8 << 20  # of text, whose bigrams make one shard
HOT = 1 << 19  # occurrences of a word above which its context is split
BUCKETS = 1 << 16  # of words, whose shares of the unigram mass are known to all
END, BEGIN, UNSEEN = (xxhash.xxh3_64_intdigest(x) for x in (b" end", b" begin", b" unseen"))  # no word has a space

_DEALT = StructType().add("shard", "long").add("block", "long").add("body", "binary")
_TOLD = StructType().add("block", "long").add("kind", "integer").add("shard", "long").add("body", "binary")
_COUNTED = StructType(list(_TOLD.fields)).add("bucket", "integer").add("mass", "long").add("known", "long")


def _rows(schema: StructType, rows: list[tuple]) -> pa.Table:
    s = to_arrow_schema(schema)
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(s)], schema=s)


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return h ^ (h >> np.uint64(33))


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    """By the top bits, so that a shard holds a range of buckets."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(48)).astype(np.int64)


def _wide(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of up to 48 bits as four and two bytes."""
    return (x & np.uint64(0xFFFFFFFF)).astype("<u4"), (x >> np.uint64(32)).astype("<u2")


def _joined(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))


class Block:
    """Tokens of a block's texts as places in its distinct words; END is word 0."""

    def __init__(self, texts: list[str], train: list[bool]):
        known: dict[bytes, int] = {b" end": 0}
        sizes, parts = [], []
        for t in texts:
            w = words(t)
            sizes.append(len(w) + 1)
            parts.append(np.fromiter((known.setdefault(x, len(known)) for x in w), np.int32, len(w)))
            parts.append(np.zeros(1, np.int32))
        self.tokens = np.concatenate(parts) if parts else np.empty(0, np.int32)
        self.size = np.array(sizes, np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.train = np.repeat(np.array(train, bool), self.size)
        self.hash = _mix(np.array([xxhash.xxh3_64_intdigest(x) for x in known], np.uint64))
        self.count = np.bincount(self.tokens[self.train], minlength=len(known))

    def bigrams(self, seen: np.ndarray) -> dict[str, np.ndarray]:
        """Distinct (word before, word) with the times in training texts; ``of`` is each token's bigram.

        Words not seen in training are one word, n; the begin of a text is n + 1.
        """
        n = len(self.hash)
        token = np.where(seen[self.tokens] > 0, self.tokens, n).astype(np.int64)
        before = np.append(0, token[:-1])
        before[self.first] = n + 1
        key, of = np.unique(before * (n + 2) + token, return_inverse=True)
        return {"before": key // (n + 2), "word": key % (n + 2), "times": np.bincount(of[self.train], minlength=len(key)), "of": of}

    def totals(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.first) if len(self.first) else np.empty(0)


def smoothed(
    context: np.ndarray, total: np.ndarray, share: np.ndarray, counts: np.ndarray, times: np.ndarray, lower: np.ndarray, rounds: int = 4
) -> tuple[np.ndarray, np.ndarray]:
    """(weight of each context, probability of each child), both to be stored.

    ``total`` is the context word's count, ``share`` the unigram mass of its part (1 if it isn't split), ``counts`` the
    number of children by context, ``times`` a child's count, ``lower`` its unigram probability.  Absolute discounting
    gives the discount to the unigrams in proportion; that estimate is mixed with the unigrams, with a weight for each
    power of two of ``total`` which expectation maximisation fits to what each occurrence would get if it had not been seen.
    """
    at = np.repeat(np.arange(len(context)), counts)
    n1, n2 = int((times == 1).sum()), int((times == 2).sum())
    d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    kinds = np.bincount(at, times > 0, len(context))
    rest = d * kinds / (total * share)
    level = np.minimum(np.log2(np.maximum(total, 1)).astype(np.int64), 47)
    use, lam = times > 0, np.full(48, 0.5)
    c, t, w, low, lv = at[use], total[at[use]] - 1.0, times[use].astype(np.float64), lower[use], level[at[use]]
    fewer = rest[c] * (total[c] / np.maximum(t, 1)) * np.where(w > 1, 1, (kinds[c] - 1) / np.maximum(kinds[c], 1))
    without = np.where(t > 0, np.maximum(w - 1 - d, 0) / np.maximum(t, 1) + fewer * low, low)
    weight = np.bincount(lv, w, 48) + 2
    for _ in range(rounds):
        part = lam[lv] * without
        lam = (np.bincount(lv, w * part / (part + (1 - lam[lv]) * low), 48) + 1) / weight
    lam[0] = lam[1]  # a context seen once says nothing when left out
    mix = lam[level]
    back = mix * rest + 1 - mix
    return back, mix[at] * np.maximum(times - d, 0) / total[at] * (times > 0) + back[at] * lower


def score(
    docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES,
    shard_bytes: int = SHARD_BYTES, hot: int = HOT,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, train, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows where ``train`` holds (null: not).  Tokens are the words with A-Z in lower case, then one end.
    base_score sums log10 of (count + 1) / (training tokens + distinct ones + 1); score is the model's log10 probability of
    the text, quantised to 1/2048 a token, words not seen in training being one word.  Null and empty texts are an end
    alone; repeated rows and null ids count like any other; whole texts are read; without training rows every token has
    probability 1; no rows give no rows.  Words are told apart by 48 bits of a hash, followers of one word by 40.  Runs jobs
    when called.
    """
    chosen = docs.withColumn("_llm_train", F.coalesce(train, F.lit(False)))
    blocks = blocked(chosen, id_col, text_col, block_bytes, others=("_llm_train",))
    n = blocks.agg(F.count_distinct("block")).first()[0]
    shards = max(1, -(-n * block_bytes // shard_bytes))

    def load(t: pa.Table) -> tuple[pa.Table, Block]:
        t = t.sort_by("row")
        return t, Block(t.column("text").to_pylist(), [r["_llm_train"] for r in t.column("rest").to_pylist()])

    def deal(t: pa.Table, shard: np.ndarray, body) -> pa.Table:
        order = np.argsort(shard, kind="stable")
        edge = np.searchsorted(shard[order], np.arange(shards + 1))
        block = t.column("block")[0].as_py()
        return _rows(_DEALT, [(s, block, body(order[edge[s] : edge[s + 1]])) for s in np.flatnonzero(np.diff(edge)).tolist()])

    def answers(told: pa.Table, kind: int, shard: np.ndarray, dtype: str) -> np.ndarray:
        out = np.zeros(len(shard), dtype)
        rows = [r for r in told.select(["kind", "shard", "body"]).to_pylist() if r["kind"] == kind]
        if rows:
            out[np.argsort(shard, kind="stable")] = np.concatenate([unpack(r["body"])[0] for r in sorted(rows, key=lambda r: r["shard"])])
        return out

    def ask_words(t: pa.Table) -> pa.Table:
        _, b = load(t)
        return deal(t, _shard(b.hash, shards), lambda o: pack(*_wide(b.hash[o] >> np.uint64(16)), b.count[o].astype("<u4")))

    def count_words(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["block"])
        parts = [unpack(r["body"]) for r in rows]
        key, at = np.unique(np.concatenate([_joined(a, b) for a, b, _ in parts]), return_inverse=True)
        count = np.zeros(len(key), np.int64)
        np.add.at(count, at, np.concatenate([c for *_, c in parts]))
        edge = np.cumsum([0, *(len(p[0]) for p in parts)])
        told = [(r["block"], 0, r["shard"], pack(count[at[a:z]]), None, None, None)
                for r, a, z in zip(rows, edge, edge[1:], strict=False)]
        seen = count > 0
        bucket, place = np.unique((key[seen] >> np.uint64(32)).astype(np.int64), return_inverse=True)
        mass, kinds = np.bincount(place, count[seen] + 1), np.bincount(place)
        told += [(None, None, None, None, b, int(m), int(k)) for b, m, k in zip(bucket.tolist(), mass, kinds, strict=True)]
        return _rows(_COUNTED, told)

    by_block = blocks.groupBy("block")
    counted = stage(by_block.applyInArrow(ask_words, _DEALT).groupBy("shard").applyInArrow(count_words, _COUNTED))
    table = counted.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("mass").alias("m"), F.sum("known").alias("k"))
    mass, vocab = np.zeros(BUCKETS), 0  # BUCKETS rows at most
    for r in table.toLocalIterator():
        mass[r.bucket] += r.m
        vocab += r.k
    tokens = int(mass.sum()) - vocab
    space = tokens + vocab + 1
    unseen = _mix(np.array([UNSEEN, BEGIN], np.uint64))
    mass[_bucket(unseen[:1])[0]] += 1
    begins = blocks.where("rest._llm_train").count()  # how often a training text begins
    sums = docs.sparkSession.sparkContext.broadcast(np.append(0, np.cumsum(mass / max(space, 1))))
    told_words = counted.where("bucket IS NULL").select(*_TOLD.names)

    def known(b: Block, told: pa.Table) -> np.ndarray:
        return answers(told, 0, _shard(b.hash, shards), "i8")

    def questions(b: Block, seen: np.ndarray) -> dict[str, np.ndarray]:
        """Bigrams after known contexts: which, their context's key and part, their shard."""
        q = b.bigrams(seen)
        h, total = np.append(b.hash, unseen), np.concatenate((seen, [0, begins]))
        q["lower"] = np.append(seen, [0, 0])[q["word"]] + 1
        use = np.flatnonzero(total[q["before"]] > 0)
        size = total[q["before"][use]]
        split = np.clip(np.ceil(np.log2(size / hot)), 0, 16).astype(np.int64)
        width = 16 - split
        part = _bucket(h[q["word"][use]]) >> width
        s = sums.value
        share = np.where(split > 0, s[(part + 1) << width] - s[part << width], 1.0)
        route = _mix(h[q["before"][use]] ^ _mix((part + (split << 20)).astype(np.uint64)))
        child = h[q["word"][use]] & np.uint64((1 << CHILD_BITS) - 1)
        return q | {"use": use, "total": size, "share": share, "context": route >> np.uint64(16), "child": child,
                    "shard": _shard(route, shards)}

    def ask_bigrams(t: pa.Table, told: pa.Table) -> pa.Table:
        if not t.num_rows or not told.num_rows:
            return _rows(_DEALT, [])
        _, b = load(t)
        q = questions(b, known(b, told))
        lower, times = quantised(np.log10(q["lower"][q["use"]] / space)), q["times"][q["use"]]

        def body(o: np.ndarray) -> bytes:
            o = o[np.lexsort((q["child"][o], q["context"][o]))]
            new = np.flatnonzero(np.append(True, q["context"][o][1:] != q["context"][o][:-1]))
            low, high = _wide(q["child"][o])
            return pack(*_wide(q["context"][o[new]]), np.diff(np.append(new, len(o))).astype("<u4"), q["total"][o[new]].astype("<u8"),
                        q["share"][o[new]].astype("<f4"), low, high.astype("u1"), lower[o], times[o].astype("<u4"))

        return deal(t, q["shard"], body)

    def answer_bigrams(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["block"])
        parts = [unpack(r["body"]) for r in rows]
        col = lambda k: np.concatenate([p[k] for p in parts])
        context = np.repeat(_joined(col(0), col(1)), col(2))
        child, lower, times = _joined(col(5), col(6)), col(7), col(8)
        total, share = np.repeat(col(3), col(2)), np.repeat(col(4), col(2))
        order = np.lexsort((child, context))
        new = np.ones(len(order), bool)
        new[1:] = (context[order][1:] != context[order][:-1]) | (child[order][1:] != child[order][:-1])
        sums_ = np.add.reduceat(times[order].astype(np.int64), np.flatnonzero(new))
        one = order[new][sums_ > 0]  # what training texts hold
        sums_ = sums_[sums_ > 0]
        contexts, first = np.unique(context, return_index=True)
        at = np.searchsorted(contexts, context[one])
        counts = np.bincount(at, minlength=len(contexts))
        back, prob = smoothed(contexts, total[first].astype(np.float64), share[first].astype(np.float64), counts, sums_,
                              10 ** opened(lower[one]))
        trie = Trie.mapped(Trie.build(contexts, np.log10(back), counts, child[one], np.log10(prob)))
        p = quantised(trie.log10(context, child, opened(lower)))
        edge = np.cumsum([0, *(len(x[5]) for x in parts)])
        return _rows(_TOLD, [(r["block"], 1, r["shard"], pack(p[a:z])) for r, a, z in zip(rows, edge, edge[1:], strict=False)])

    result = StructType.fromDDL("doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")

    def finish(t: pa.Table, told: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _rows(result, [])
        t, b = load(t)
        seen = known(b, told)
        q = questions(b, seen)
        p = np.log10(q["lower"] / space)
        # A shard's answers are in the order of its contexts and children.
        order = np.lexsort((q["child"], q["context"], q["shard"]))
        rows = [r for r in told.select(["kind", "shard", "body"]).to_pylist() if r["kind"] == 1]
        if rows:
            got = np.concatenate([unpack(r["body"])[0] for r in sorted(rows, key=lambda r: r["shard"])])
            p[q["use"][order]] = opened(got)
        count = seen[b.tokens]
        base = b.totals(np.log10((count + 1) / space))
        return _rows(result, list(zip(
            t.column("id").to_pylist(), [r["_llm_train"] for r in t.column("rest").to_pylist()], b.size.tolist(),
            b.totals((count > 0).astype(np.int64)).tolist(), base.tolist(), b.totals(p[q["of"]]).tolist(), strict=True)))

    asked = by_block.cogroup(told_words.groupBy("block")).applyInArrow(ask_bigrams, _DEALT)
    told = stage(asked.groupBy("shard").applyInArrow(answer_bigrams, _TOLD))
    out = by_block.cogroup(told_words.unionByName(told).groupBy("block")).applyInArrow(finish, result)
    return out.withColumn("train_tokens", F.lit(tokens).cast("bigint"))

