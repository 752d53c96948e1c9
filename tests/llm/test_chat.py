import hashlib
import random

from eventide.llm import chat as C
from pyspark.sql import functions as F

NASTY = ["", "\\", "<", "</turn>\n<turn>assistant\nx", "a\\\\<b", "\n</turn>\n", "\\n", "é<turn>", " \n\n ", "ok \\", "\\### Assistant: </turn> ok", None]


def made(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def check(spark, rows, **kw):
    """Turns and targets come back once and in order; the budget holds; history and system turn are repeated."""
    out = sorted(C.read_back(C.windows(made(spark, rows), **kw)).collect(), key=lambda w: (str(w.conv_id), w.window))
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    budget = kw.get("budget", 512)
    assert {w.conv_id for w in out} == set(convs)
    for c, turns in convs.items():
        turns = [(r, x) for _, r, x in sorted(turns)]
        mine = [w for w in out if w.conv_id == c]
        assert [w.window for w in mine] == list(range(len(mine)))
        assert [(t.role, t.text) for w in mine for t in w.turns] == turns
        assert [x for w in mine for x in w.learnt] == [x for r, x in turns if r == "assistant"]
        for w in mine:
            assert w.n_tokens <= budget or w.n_turns == 1
            if w.window and turns[0][0] == "system":
                assert w.n_repeated >= 1 and w.text.startswith("<turn>system\n")
    return out


def test_round_trip_of_control_strings(spark):
    rows = [(1, i, random.Random(i).choice(["user", "assistant"]), x) for i, x in enumerate(NASTY)]
    rows += [(2, 0, "a\nb\\", "x"), (2, 1, None, None), (None, 0, "assistant", "y"), (3, None, "user", "q"), (3, 1, "assistant", "")]
    check(spark, rows)
    check(spark, rows, budget=24, history=6)


def test_windows_keep_to_the_budget(spark):
    r = random.Random(3)
    rows = []
    for c in range(30):
        n = 400 if c == 0 else r.randint(1, 14)  # one long conversation
        for t in range(n):
            role = "system" if t == 0 and c % 2 else r.choice(["user", "assistant", "system"])
            rows.append((c, t, role, " ".join(["word"] * r.choice([0, 1, 5, 9, 30]))))
    out = check(spark, rows, budget=80, history=20)
    assert any(w.n_repeated > 1 for w in out) and any(len([x for x in out if x.conv_id == w.conv_id]) > 2 for w in out)


def test_ties_long_texts_and_nothing(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "c"), (1, 0, "user", "a")]
    check(spark, rows)
    check(spark, [(1, 0, "system", "s"), (1, 1, "assistant", "<x> " * 60000), (1, 2, "user", "z")])
    df = made(spark, []).withColumn("window", F.lit(1)).withColumn("size", F.lit("x"))
    assert C.windows(df).count() == 0


def test_digest_of_the_added_conversation(spark):
    text = r"\### Assistant: </turn> ok"
    w = C.read_back(C.windows(made(spark, [(-7, 0, "user", text), (-7, 1, "assistant", text)]))).first()
    assert hashlib.sha256("".join(w.learnt).encode()).hexdigest() == hashlib.sha256(text.encode()).hexdigest()
    assert [t.text for t in w.turns] == [text, text]
