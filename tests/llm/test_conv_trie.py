import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from eventide.llm import conv_trie as C
from eventide.llm import queries as Q

COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def plain_convs(rows):
    out = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((r or "", x or ""))
    return out


def plain_rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 4
        base = [] if c is None else convs.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])
        out[c] = base[:h] + own[h:]
    return out


def plain_trie(convs):
    """All nodes by definition: prefixes, members, subtrees."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    least = lambda cs: min((c for c in cs if c is not None), default=None)
    rows = []
    for path, cs in members.items():
        kids = [p for p in members if len(p) == len(path) + 1 and p[: len(path)] == path]
        below = [p for p in members if p[: len(path)] == path]
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below)
        saved = sum((len(members[p]) - 1) * (len(p[-1][1].encode().split()) if p else 0) for p in below)
        ends = ",".join(map(str, sorted(c for c in cs if c is not None and len(convs[c]) == len(path))))
        rows.append((least(cs), len(path), least(members[path[:-1]]) if path else None, len(cs), len(kids), leaves, saved,
                     hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def made(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def some_rows(seed, ids):
    r = random.Random(seed)
    rows = []
    for c in ids:
        for t in range(r.randint(1, 5)):
            rows.append((c, r.choice([t, t, None]), r.choice(["user", "assistant", None]), r.choice(["a", "b b", "", None, "é ü"])))
    return rows


@pytest.mark.parametrize("convs,turns", [(C.SHARD_CONVS, C.SHARD_TURNS), (5, 1000), (1, 1), (64, 7)])
def test_shards_of_any_size(spark, convs, turns):
    rows = some_rows(convs, [*range(90), -3, -25, 1005, None, 10**12])
    df = made(spark, rows + rows[:9]).withColumn("key", F.lit(1)).withColumn("shard", F.lit("x")).repartition(5)
    numbered = C.numbered(df)
    convs_of = plain_convs(rows + rows[:9])
    assert got(C.prefix_trie(numbered, convs, turns)) == plain_trie(convs_of)
    assert got(C.prefix_trie(C.with_shared_heads(numbered), convs, turns)) == plain_trie(plain_rebuilt(convs_of))


def test_conversations_left_without_turns(spark):
    ids = [c for c in range(21, 300) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20][:12]
    rows = [(c, t, "user", f"{t} x") for c in ids for t in range(2)]
    want = plain_trie(plain_rebuilt(plain_convs(rows)))
    assert want == [(min(ids), 0, None, len(ids), 0, 1, 0, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())]
    assert got(C.prefix_trie(C.with_shared_heads(C.numbered(made(spark, rows))))) == want


def test_hot_beginnings_long_ones_and_nothing(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(c, t, "user", "same words here") for c in range(300) for t in range(3)]
        rows += [(1000, t, "user", f"turn {t}") for t in range(3000)] + [(1001, t, "user", f"turn {t}") for t in range(2999)]
        rows += [(1002, 0, "user", "w " * 300_000)]
        df = C.prefix_trie(C.numbered(made(spark, rows).repartition(9)), 64)
        all_rows = {(r.conv_id, r.depth): r for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(all_rows) == 1 + 3 + 3000 + 1
    root, same, long_one = all_rows[0, 0], all_rows[0, 3], all_rows[1000, 1]
    assert (root.n_convs, root.n_children, root.n_leaves) == (303, 3, 3) and root.saved_tokens == 299 * 9 + 2 * 2999
    assert (same.n_convs, same.ends_sha256) == (300, hashlib.sha256(",".join(map(str, range(300))).encode()).hexdigest())
    assert (long_one.n_convs, long_one.n_leaves, long_one.saved_tokens) == (2, 1, 2 * 2999)
    assert all_rows[1000, 2999].n_children == 1 and all_rows[1002, 1].n_convs == 1
    assert C.prefix_trie(C.with_shared_heads(C.numbered(made(spark, [])))).count() == 0


def test_query_against_the_definition(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(Q.op12_trie(spark, sf)) == plain_trie(plain_rebuilt(plain_convs(rows)))
