import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from eventide.llm import queries as Q
from eventide.llm import repair as R

GOOD = re.compile(r"(s?(ua)+)?")
NO_ROLE = "\0"


def plain_damage(rows):
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k:
            x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
            out += [(c, t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
    return out


def every_edit(kinds):
    """Least (cost, audit) of all edit lists with at most two inserts in a row, by trying them all."""
    best = None
    options = []
    for k, x in kinds:
        extra = 3 if k == "truncated" else 0
        o = [("D", 4, "")]
        if k in ("", "truncated"):
            o += [("K", extra, x), ("R", 3 + extra, "u"), ("R", 3 + extra, "a")]
        options.append(o)
    inserts = [list(p) for n in range(3) for p in itertools.product("ua", repeat=n)]
    for ops in itertools.product(*options):
        for ins in itertools.product(inserts, repeat=len(kinds) + 1):
            audit = cost = 0
            text, audit = "", ""
            for k, some in enumerate(ins):
                text += "".join(some)
                audit += "I" * len(some)
                cost += 3 * len(some)
                if k < len(ops):
                    audit, cost, text = audit + ops[k][0], cost + ops[k][1], text + ops[k][2]
            if GOOD.fullmatch(text) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def kinds_of(rows):
    """(fault, initial) of rows in order."""
    seen, out = set(), []
    for _, _, r, x in rows:
        body = x.strip(" \t\n\v\f\r")
        fault = "blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((r, x))
        out.append((fault, r[:1] or NO_ROLE))
    return out


def plain_table(kinds):
    """The same by a table over rows and the last initial, inserts before each row tried one and two at a time."""
    after = lambda s, x: {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((s, x))

    def inserted(table):
        for _ in range(2):
            for s, (c, a) in list(table.items()):
                for x in "ua":
                    t = after(s, x)
                    if t is not None:
                        table[t] = min(table.get(t, (1e9, "")), (c + 3, a + "I"))
        return table

    table = inserted({"": (0, "")})
    for k, x in kinds:
        extra, new = 3 if k == "truncated" else 0, {}
        for s, (c, a) in table.items():
            steps = [(s, 4, "D")]
            if k in ("", "truncated"):
                steps += [(after(s, x), extra, "K"), (after(s, "u"), 3 + extra, "R"), (after(s, "a"), 3 + extra, "R")]
            for t, more, letter in steps:
                if t is not None:
                    new[t] = min(new.get(t, (1e9, "")), (c + more, a + letter))
        table = inserted(new)
    return min(table[s] for s in ("", "a") if s in table)


def plain(rows):
    """conv_id: all columns of the contract, from rows before the damage."""
    out = {}
    bad = plain_damage(rows)
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in bad if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        kinds = kinds_of(mine)
        turns = [r[1] for r in mine if r[1] is not None]
        cost, audit = plain_table(kinds)
        lines, state, i = [], "", 0
        for e in audit:
            if e != "I":
                _, _, role, text = mine[i]
                i += 1
            if e == "D":
                continue
            x = role[0] if e == "K" else "a" if state == "u" else "u"
            name = role if e == "K" else {"u": "user", "a": "assistant"}[x]
            lines.append(f"{name}:{'' if e == 'I' else text}")
            state = x
        assert i == len(mine) and state in ("", "a")
        pairs = [a[1] + b[1] for a, b in itertools.pairwise(kinds)]
        count = [k for k, _ in kinds].count
        out[c] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count("blank"), count("duplicate"), count("truncated"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def got(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[n] for n in "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()) for r in rows}


def made(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_agenda_against_every_edit():
    r = random.Random(3)
    for _ in range(60):
        kinds = [(r.choice(["", "", "truncated", "blank"]), r.choice("suax")) for _ in range(r.randint(0, 3))]
        pattern = "".join("d" if k == "blank" else x.upper() if k else x for k, x in kinds)
        (best,) = R.lightest(pattern).values()
        assert best == every_edit(kinds) == plain_table(kinds)


@pytest.mark.parametrize("block", [1, 2, 1024])
def test_pieces_joined_give_the_same(block):
    r = random.Random(block)
    for _ in range(150):
        rows = [(i // 4, r.choice(["user", "assistant", "system", "", "tool"]), r.choice(["a.", "b", "", "c?", " "]), r.choice([1, 1, 1, 2]), r.choice([0, 1]))
                for i in range(r.randint(0, 12))]
        pieces = [R.Piece()]
        flat = [(t, ro, x, bool(k) or not f) for t, ro, x, n, f in rows for k in range(n)]
        for row in flat:
            if pieces[-1].n == block:
                pieces.append(R.Piece())
            pieces[-1].add(*row)
        fold = R.Fold(1, True)
        for p in pieces:
            fold.take(p, {a: R.derive("".join(p.pattern), a, False) for a in fold.border})
        have = fold.result()
        kinds = [("blank" if not x.strip() else "duplicate" if again else "truncated" if x[-1] not in ".!?" else "", ro[:1] or NO_ROLE)
                 for _, ro, x, again in flat]
        assert (have["cost"], have["audit"]) == plain_table(kinds)
        assert have["illegal"] == sum(a[1] + b[1] not in ("su", "ua", "au") for a, b in itertools.pairwise(kinds))
        turns = [t for t, *_ in flat]
        assert have["gaps"] == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        assert GOOD.fullmatch("".join(t["role"][0] for t in have["repaired"]))


def odd_rows(r):
    rows = []
    for c in [*range(60), None]:
        for t in range(r.randint(1, 9)):
            turn = r.choice([t, t, t, t + 3, None])
            rows.append((c, turn, r.choice(["user", "assistant", "system", "", None, "usher"]), r.choice(["a.", "b", "", None, "Ja! ", "é?\n", "x.  y"])))
    return rows + rows[:20]


@pytest.mark.parametrize("block,held", [(1024, 16), (2, 2), (1, 1)])
def test_whole_tables(spark, block, held):
    rows = odd_rows(random.Random(block))
    df = made(spark, rows).withColumn("copies", F.lit("x")).withColumn("piece", F.lit(1)).withColumn("cost", F.lit(2))
    assert got(R.repair(R.damaged(df), block=block, held=held)) == plain(rows)


def test_long_conversation_over_many_partitions(spark):
    r = random.Random(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = [(5, t, r.choice(["user", "assistant", "system"]), r.choice([f"t{t}.", f"t{t // 7}", "same."])) for t in range(6000)]
    rows += [(4, 0, "user", "x."), (6, 0, "user", "y.")] + [(7, 1, "user", "z.")] * 3000
    try:
        assert got(R.repair(R.damaged(made(spark, rows).repartition(16)))) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_long_texts_extra_columns_and_nothing(spark):
    rows = [(1, 0, "user", "w " * 400_000 + "."), (1, 1, "assistant", "v" * 1_000_000), (2, 0, "user", " " * 300_000)]
    assert got(R.repair(R.damaged(made(spark, rows)))) == plain(rows)
    assert R.repair(R.damaged(made(spark, []))).count() == 0
    one = R.repair(made(spark, [(1, 0, "user", "Hi."), (1, 1, "user", "There.")]), texts=True).first()
    assert [(t.edit, t.role, t.text) for t in one.repaired] == [("K", "user", "Hi."), ("R", "assistant", "There.")]


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_against_plain_loops(spark, size):
    sf = f"/root/testdata/{size}"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(Q.op11_repair(spark, sf)) == plain(rows)
