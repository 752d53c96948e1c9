r"""Chat formatting in budgeted windows, with DataFrame functions only.

Template of a turn: ``<turn>role\ntext\n</turn>\n``.  Inside role and text every ``\`` and ``<`` gets a ``\`` in front (in
a role a line feed too), so no text can hold a mark, and :func:`read_back` undoes it exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN, CLOSE = "<turn>", "\n</turn>\n"


def escape(text: Column, role: bool = False) -> Column:
    return F.regexp_replace(text, r"([\\<\n])" if role else r"([\\<])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def rough_tokens(text: Column) -> Column:
    """Words, numbers and single other marks."""
    return F.regexp_count(text, F.lit(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]")).cast("bigint")


def turn_text(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(role, True), F.lit("\n"), escape(text), F.lit(CLOSE))


def windows(
    turns: DataFrame, budget: int = 512, history: int = 64, target: str = "assistant", system: str = "system",
    tokens: Callable[[Column], Column] = rough_tokens,
) -> DataFrame:
    """Windows of conversations: conv_id, window, text, n_tokens, n_repeated, n_turns, loss (array of start, length).

    ``turns`` has conv_id, turn, role and text; turns are ordered by turn, then role and text, so repeated turn numbers
    have a fixed order, and nulls come first.  Null roles and texts are empty; a null conv_id is a conversation; extra
    columns are ignored; no turns give no windows.

    Prefix sums of the turns' tokens choose the spans.  A span is made of the turns that start in the same stretch of
    half the room, so a turn of at most half the room never takes it over the room; longer turns stand alone, whole even
    if they are longer than the budget.  The room is the budget without the system turn and the history.  Every window
    but the first starts with the leading system turn, if there is one, and the last turns of the span before, up to
    ``history`` tokens; these are counted in n_repeated.  ``loss`` covers each target text once, in code points of
    ``text`` counted from 0: repeated targets are masked.  Windows are ordered and numbered from 0.
    """
    c = F.col
    rows = turns.select(
        "conv_id", "turn", F.coalesce(c("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(c("text").cast("string"), F.lit("")).alias("body"),
    ).withColumn("shown", turn_text(c("role"), c("body")))
    rows = rows.withColumn("size", tokens(c("shown")))
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    lead = c("at") == 1
    is_system = lead & (c("role") == system)
    rows = rows.select(
        "*", F.row_number().over(in_order).alias("at"), F.sum("size").over(so_far).alias("upto"),
    ).withColumn("leading", F.when(is_system, F.struct("shown", "size")))
    rows = rows.withColumn("leading", F.first("leading", ignorenulls=True).over(so_far))
    room = F.greatest(F.lit(budget - history) - F.coalesce(c("leading.size"), F.lit(0)), F.lit(2))
    long_turn = c("size") * 2 > room
    rows = rows.withColumns({"long": long_turn, "stretch": F.floor((c("upto") - c("size")) * 2 / room)})
    alone = c("long") | F.lag("long").over(in_order) | (F.lag("stretch").over(in_order) != c("stretch"))
    starts = F.when(c("at") == 1, 0).otherwise(alone.cast("bigint"))
    rows = rows.select("*", starts.alias("starts"))
    rows = rows.withColumn("window", F.sum("starts").over(so_far))
    span_end = F.max("upto").over(Window.partitionBy("conv_id", "window"))
    last = F.max("window").over(Window.partitionBy("conv_id"))
    rows = rows.withColumns({"span_end": span_end, "last": last})
    tail = (c("span_end") - (c("upto") - c("size")) <= history) & (c("window") < c("last")) & ~is_system
    uses = F.when(tail, F.array(F.struct(c("window").alias("w"), F.lit(False).alias("again")),
                                F.struct((c("window") + 1).alias("w"), F.lit(True).alias("again"))))
    uses = uses.otherwise(F.array(F.struct(c("window").alias("w"), F.lit(False).alias("again"))))
    placed = rows.withColumn("use", F.explode(uses)).select(
        "conv_id", c("use.w").alias("window"), "leading",
        F.struct("at", "shown", "size", (c("use.again")).alias("again"), ((c("role") == target) & ~c("use.again")).alias("learn"),
                 (F.char_length(F.lit(OPEN)) + F.char_length(escape(c("role"), True)) + 1).alias("before")).alias("t"),
    )
    spans = placed.groupBy("conv_id", "window").agg(
        F.first("leading").alias("leading"), F.sort_array(F.collect_list("t")).alias("ts")
    )
    head = F.when((c("window") > 0) & c("leading").isNotNull(), F.array(F.struct(
        F.lit(0).alias("at"), c("leading.shown").alias("shown"), c("leading.size").alias("size"), F.lit(True).alias("again"),
        F.lit(False).alias("learn"), F.lit(0).alias("before"))))
    spans = spans.withColumn("ts", F.when(head.isNotNull(), F.concat(head, c("ts"))).otherwise(c("ts")))
    none = F.array().cast("array<struct<start:int,length:int>>")
    loss = F.aggregate(
        "ts", F.struct(F.lit(0).alias("at"), none.alias("found")),
        lambda acc, t: F.struct(
            (acc["at"] + F.char_length(t["shown"])).alias("at"),
            F.when(t["learn"], F.array_append(acc["found"], F.struct(
                (acc["at"] + t["before"]).alias("start"),
                (F.char_length(t["shown"]) - t["before"] - len(CLOSE)).alias("length"),
            ))).otherwise(acc["found"]).alias("found"),
        ),
        lambda acc: acc["found"],
    )
    count = lambda cond: F.size(F.filter("ts", cond)).cast("bigint")
    return spans.select(
        "conv_id", "window", F.array_join(F.transform("ts", lambda t: t["shown"]), "").alias("text"),
        F.aggregate("ts", F.lit(0).cast("bigint"), lambda a, t: a + t["size"]).alias("n_tokens"),
        count(lambda t: t["again"]).alias("n_repeated"), count(lambda t: ~t["again"]).alias("n_turns"), loss.alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``turns``, the new turns of each window as (role, text) in clear, and ``learnt``, its loss texts."""
    parts = F.slice(F.split("text", r"(?<!\\)<turn>"), F.col("n_repeated") + 2, F.greatest(F.col("n_turns"), F.lit(1)))
    role = lambda p: F.regexp_extract(p, r"(?s)^((?:[^\\\n]|\\.)*)\n", 1)
    body = lambda p: F.substring(p, F.char_length(role(p)) + 2, F.char_length(p) - F.char_length(role(p)) - 1 - len(CLOSE))
    return formatted.withColumns({
        "turns": F.transform(parts, lambda p: F.struct(unescape(role(p)).alias("role"), unescape(body(p)).alias("text"))),
        "learnt": F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["length"]))),
    })
