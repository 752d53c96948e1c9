"""Prefix trie of conversations from vertical bitmaps.

Conversations are dealt to shards, ranges of conv_id.  A shard has an index from (position, turn) to the bitset of its conversations
with that turn there.  Depth first, a node's bitset and a posting of the next position give the bitset of a child; its bits
are the members, those that have no further turn are the node's ends.  A node of the whole trie is a node of one or
more shards with the same digest of its turns, and belongs to the shard of its smallest member.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from eventide.llm.common import stage
from eventide.llm.turns import batched, in_order, listed

SHARD_CONVS = 2048
SHARD_TURNS = 1 << 17
KEY = 16  # bytes of a digest of a turn, or of all turns up to a node
ROOT = bytes(KEY)
_L, _B = T.LongType(), T.BinaryType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


TURNS = _struct(conv_id=_L, part=T.IntegerType(), at=_L, turn_key=_B, words=_L)
NODES = _struct(
    shard=_L, idx=T.IntegerType(), size=T.IntegerType(), parent=T.IntegerType(), depth=_L, key=_B, conv_id=_L, n=_L, words=_L,
    childless=T.BooleanType(), ends=T.StringType(),
)


def turn_key(role: str, text: str) -> bytes:
    r = role.encode("utf-8", "surrogatepass")
    return hashlib.blake2b(b"%d:%b%b" % (len(r), r, text.encode("utf-8", "surrogatepass")), digest_size=KEY).digest()


def child_key(parent: bytes, turn: bytes) -> bytes:
    return hashlib.blake2b(parent + turn, digest_size=KEY).digest()


def numbered(turns: DataFrame) -> DataFrame:
    """Turns without their texts, as a table: conv_id, part and at (order), turn_key (digest of role and text), words of the text.

    ``turns`` has conv_id, turn, role and text.  Turns count by turn (nulls first), then role, then text; null roles and texts are
    empty; other columns are ignored.
    """
    c = F.col
    rows = turns.select(
        c("conv_id").cast("long"), c("turn").cast("long"), *[F.coalesce(c(n).cast("string"), F.lit("")).alias(n) for n in ("role", "text")]
    )
    arrow = to_arrow_schema(TURNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def out():
            key, at = object(), 0
            for conv_id, _, role, text in listed(batches):
                key, at = conv_id, at + 1 if conv_id == key else 0
                yield conv_id, part, at, turn_key(role, text), len(text.encode("utf-8", "surrogatepass").split())

        return batched(out(), arrow, 4096)

    return stage(in_order(rows).mapInArrow(run, TURNS))


def with_shared_heads(rows: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """Conversations rebuilt with the beginning of another one: the first h turns of conversation ``c - c % group``, all if it has
    fewer, none if it is absent, then what follows c's own first h turns; h is crc32 of c modulo ``heads``, 0 for a null c.

    Takes and gives what :func:`numbered` gives.  A conversation left without turns keeps a row whose turn_key is null.  Only the
    first turns of each conversation and part are looked at: no other can be among the first h.
    """
    c = F.col
    h = F.coalesce(F.crc32(c("conv_id").cast("string").cast("binary")) % heads, F.lit(0))
    early = c("at") < heads - 1
    place = Window.partitionBy("conv_id").orderBy("part", "at")
    first = rows.where(early).withColumn("place", F.row_number().over(place))
    own = first.withColumn("turn_key", F.when(c("place") > h, c("turn_key"))).drop("place")
    source = first.where((c("conv_id") % group == 0) & (c("place") < heads))
    source = source.select(c("conv_id").alias("base"), "place", "turn_key", "words")
    asked = rows.select("conv_id").distinct().select("conv_id", (c("conv_id") - c("conv_id") % group).alias("base"), h.alias("h"))
    taken = asked.where("h > 0").join(source, "base").where("place <= h")
    taken = taken.select("conv_id", F.lit(-1).alias("part"), c("place").cast("long").alias("at"), "turn_key", "words")
    return taken.unionByName(own).unionByName(rows.where(~early))


class Shard:
    """Conversations of a range of ids, their turns, and the vertical index."""

    def __init__(self, number: int):
        self.number, self.ids, self.turns = number, [], 0
        self.sequences: list[list[bytes]] = []
        self.words: list[list[int]] = []

    def begin(self, conv_id: int | None) -> None:
        self.ids.append(conv_id)
        self.sequences.append([])
        self.words.append([])

    def add(self, turn: bytes, words: int) -> None:
        self.sequences[-1].append(turn)
        self.words[-1].append(words)
        self.turns += 1

    def nodes(self) -> Iterator[tuple]:
        """Nodes in preorder, with the number of nodes in each one's subtree."""
        postings: list[dict[bytes, int]] = [defaultdict(int) for _ in range(max(map(len, self.sequences)))]
        longer = [0] * (len(postings) + 1)  # conversations with more turns than the depth
        for k, turns in enumerate(self.sequences):
            bit = 1 << k
            for d, t in enumerate(turns):
                postings[d][t] |= bit
                longer[d] |= bit
        found: list[tuple] = []
        parents: list[int] = []
        open_nodes = [((1 << len(self.ids)) - 1, 0, ROOT, -1, 0)]
        while open_nodes:
            members, depth, key, parent, words = open_nodes.pop()
            idx = len(found)
            rest = members & longer[depth]
            ended = members ^ rest
            found.append((depth, key, self._least(members), members.bit_count(), words, rest == 0, self._listed(ended) if ended else None))
            parents.append(parent)
            children = []
            while rest:
                one = (rest & -rest).bit_length() - 1
                turn = self.sequences[one][depth]
                child = members & postings[depth][turn]
                rest ^= child
                children.append((child, depth + 1, child_key(key, turn), idx, self.words[one][depth]))
            open_nodes += reversed(children)
        sizes = [1] * len(found)
        for i in range(len(found) - 1, 0, -1):
            sizes[parents[i]] += sizes[i]
        for i, node in enumerate(found):
            yield (self.number, i, sizes[i], parents[i], *node)

    def _members(self, bits: int) -> Iterator[int]:
        while bits:
            k = (bits & -bits).bit_length() - 1
            bits &= bits - 1
            if self.ids[k] is not None:
                yield self.ids[k]

    def _least(self, bits: int) -> int | None:
        return next(self._members(bits), None)

    def _listed(self, bits: int) -> str:
        return ",".join(map(str, self._members(bits)))


def _shards(rows: Iterator[tuple], part: int, convs: int, turns: int) -> Iterator[tuple]:
    """Nodes of all shards of a partition; rows are sorted by conversation and place."""
    shard, n, key = Shard(part << 32), 0, object()
    for conv_id, _, _, turn, words in rows:
        if conv_id != key:
            if len(shard.ids) >= convs or shard.turns >= turns:
                yield from shard.nodes()
                n += 1
                shard = Shard(part << 32 | n)
            shard.begin(conv_id)
            key = conv_id
        if turn is not None:
            shard.add(turn, words)
    if shard.ids:
        yield from shard.nodes()


def shard_nodes(rows: DataFrame, convs: int = SHARD_CONVS, turns: int = SHARD_TURNS) -> DataFrame:
    """Nodes of every shard, as a table.  Shards follow each other in the order of conv_id, a null first."""
    arrow = to_arrow_schema(NODES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(_shards(listed(batches, 4096), TaskContext.get().partitionId(), convs, turns), arrow, 4096)

    names = TURNS.names
    dealt = rows.select(*names).repartitionByRange("conv_id").sortWithinPartitions("conv_id", "part", "at")
    return stage(dealt.mapInArrow(run, NODES))


_SUMS = _struct(key=_B, depth=_L, conv_id=_L, parent_conv_id=_L, n_convs=_L, n_children=_L, n_leaves=_L, saved_tokens=_L)


def _sums(t: pa.Table) -> pa.Table:
    """What a shard adds to each of its nodes: sums over those below that belong to the shard."""
    t = t.sort_by("idx")
    number = lambda n: t.column(n).to_numpy().astype(np.int64)
    idx, size, parent, n_all = np.arange(t.num_rows), number("size"), number("parent"), number("n_convs")
    mine = t.column("mine").to_numpy()
    below = lambda x: (s := np.concatenate([[0], np.cumsum(x)]))[idx + size] - s[idx]
    children = np.bincount(parent[mine & (parent >= 0)], minlength=t.num_rows)
    owner = t.column("owner")
    above = pc.take(owner, pa.array(np.maximum(parent, 0)))
    return pa.table({
        "key": t.column("key"), "depth": t.column("depth"), "conv_id": owner,
        "parent_conv_id": pc.if_else(pa.array(mine & (parent >= 0)), above, pa.scalar(None, pa.int64())),
        "n_convs": t.column("n_convs"), "n_children": children,
        "n_leaves": below((mine & t.column("childless").to_numpy()).astype(np.int64)),
        "saved_tokens": below(np.where(mine, (n_all - 1) * number("words"), 0)),
    }).cast(to_arrow_schema(_SUMS))


def ends_digest(nodes: DataFrame) -> DataFrame:
    """key, ends_sha256: digest of the ends' ids, shard after shard; a shard's list is one value, a node's lists are streamed."""
    out = _struct(key=_B, ends_sha256=T.StringType())
    arrow = to_arrow_schema(out)

    def digests(rows: Iterator[tuple]) -> Iterator[tuple]:
        key = sha = None
        any_before = False
        for k, _, ends in rows:
            if k != key:
                if sha:
                    yield key, sha.hexdigest()
                key, sha, any_before = k, hashlib.sha256(), False
            if ends:
                sha.update((b"," if any_before else b"") + ends.encode())
                any_before = True
        if sha:
            yield key, sha.hexdigest()

    lists = nodes.where("ends IS NOT NULL").select("key", "shard", "ends")
    lists = lists.repartition("key").sortWithinPartitions("key", "shard")
    return lists.mapInArrow(lambda b: batched(digests(listed(b, 64)), arrow, 4096), out)


def prefix_trie(rows: DataFrame, convs: int = SHARD_CONVS, turns: int = SHARD_TURNS) -> DataFrame:
    """Nodes of the trie of all conversations, root included.

    ``rows`` is what :func:`numbered` gives.  A node is a distinct sequence of first turns (role, text), told apart by 128-bit digests.  Columns:
    conv_id: its smallest member (a conversation that starts with it), null if only a conversation without an id does; depth;
    parent_conv_id: that of its parent, null for the root; n_convs: members; n_children; n_leaves: childless nodes in its subtree, itself
    included; saved_tokens: over its subtree, the words of a node's last turn times its members but one; ends_sha256: digest of the
    ids of members without a further turn, ascending and comma-joined, null ids left out.  No conversations give no nodes.

    A node is in a shard at most once, so joins by node are as even as shards are, however many members it has.  A shard holds
    ``convs`` conversations and ``turns`` turns at most, or a single longer conversation: 24 bytes a turn.
    """
    c = F.col
    local = shard_nodes(rows, convs, turns)
    whole = local.groupBy("key").agg(
        F.min("conv_id").alias("owner"), F.sum("n").alias("n_convs"), F.min("childless").alias("childless"))
    told = local.drop("childless", "n", "ends").join(whole, "key").withColumn("mine", c("conv_id").eqNullSafe(c("owner")))
    sums = told.groupBy("shard").applyInArrow(_sums, _SUMS)
    nodes = sums.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.max("parent_conv_id").alias("parent_conv_id"),
        F.min("n_convs").alias("n_convs"), *[F.sum(n).alias(n) for n in ("n_children", "n_leaves", "saved_tokens")],
    )
    none = F.sha2(F.lit("").cast("binary"), 256)
    return nodes.join(ends_digest(local), "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
