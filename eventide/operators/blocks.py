"""Ordered computations over keys of any size.

A window keyed by camera alone puts one camera's whole history in one task.
Here each key's rows are cut into time blocks; windows run inside a block, and
what a block needs from before (or after) it comes from a summary with one row
per (key, block).  The summary is aggregated map-side before it is shuffled,
and only the summary is ever ordered per key.

Nothing here is approximate: results equal the unblocked window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = "_block"
CORE = "_core"


def micros(seconds: float) -> int:
    return int(round(seconds * 1_000_000))


def block_of(us: Column, block_s: float) -> Column:
    """Block number of an epoch-microsecond value (integer arithmetic only)."""
    size = F.lit(micros(block_s))
    return ((us - F.pmod(us, size)) / size).cast("bigint")


def with_block(df: DataFrame, block_s: float, ts: str = "ts") -> DataFrame:
    return df.withColumn(BLOCK, block_of(F.unix_micros(ts), block_s))


def fitted(
    df: DataFrame, keys: Sequence[str], block_s: float, ts: str = "ts", rows: int = 500_000, least_s: float = 1.0
) -> float:
    """The longest block length, ``block_s`` or a quarter, a sixteenth ... of it, at which no block of a key has over ``rows`` rows.

    Density decides, not the calendar: a busier camera or a larger journal gets shorter blocks, and results don't depend
    on them.  Never under ``least_s``, which must cover what an operator looks back over.  Counts are added up map-side;
    one number comes to the driver for each length tried.
    """
    while block_s / 4 >= least_s:
        per = df.groupBy(*keys, block_of(F.unix_micros(ts), block_s)).count()
        if (per.agg(F.max("count")).first()[0] or 0) <= rows:
            break
        block_s /= 4
    return block_s


def within(keys: Sequence[str], *order: str | Column) -> WindowSpec:
    """Window over one block of one key."""
    return Window.partitionBy(*keys, BLOCK).orderBy(*order)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def carry(
    df: DataFrame,
    keys: Sequence[str],
    aggs: dict[str, Column],
    merge: Callable[[Column], Column] | dict[str, Callable[[Column], Column]] = F.max,
    backward: bool = False,
) -> DataFrame:
    """Per (key, block): each aggregate merged over all earlier (later) blocks.

    Blocks without rows have no summary row; ``merge`` must be a window
    aggregate that ignores NULLs.
    """
    summary = df.groupBy(*keys, BLOCK).agg(*(c.alias(n) for n, c in aggs.items()))
    order = F.col(BLOCK).desc() if backward else F.col(BLOCK)
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    pick = merge if isinstance(merge, dict) else {n: merge for n in aggs}
    return summary.select(*keys, BLOCK, *(pick[n](F.col(n)).over(w).alias(n) for n in aggs))


def join_carry(df: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach a summary; no broadcast hint, the planner goes by its measured size."""
    return df.join(summary, [*keys, BLOCK], "left")


def number(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str, block_s: float, ts: str = "ts",
    counted: DataFrame | None = None,
) -> DataFrame:
    """``row_number`` per key in time order (``order`` must start with ``ts``).

    ``counted`` is a cheaper table with the same rows to count blocks from.
    """
    b = with_block(df, block_s, ts)
    c = b if counted is None else with_block(counted, block_s, ts)
    before = carry(c, keys, {"_before": F.count(F.lit(1))}, F.sum)
    rn = F.row_number().over(within(keys, *order))
    return (
        join_carry(b.withColumn("_rn", rn), before, keys)
        .withColumn(out, (F.col("_rn") + F.coalesce("_before", F.lit(0))).cast("bigint"))
        .drop("_rn", "_before", BLOCK)
    )


def previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, str], block_s: float, ts: str = "ts"
) -> DataFrame:
    """``lag(1)`` of columns per key: ``values`` maps new name to source column."""
    b = with_block(df, block_s, ts)
    row = F.struct(*order, *(F.col(c).alias(f"_v{i}") for i, c in enumerate(values.values())))
    before = carry(b, keys, {"_last": F.max_by(row, F.struct(*order))}, lambda c: F.last(c, ignorenulls=True))
    w = within(keys, *order)
    out = join_carry(b, before, keys)
    first = F.row_number().over(w) == 1
    for i, (name, src) in enumerate(values.items()):
        out = out.withColumn(name, F.when(first, F.col("_last")[f"_v{i}"]).otherwise(F.lag(src).over(w)))
    return out.drop("_last", BLOCK)


def halo(df: DataFrame, block_s: float, back_s: float, ts: str = "ts") -> DataFrame:
    """Rows also copied into later blocks that look back ``back_s`` seconds.

    ``_core`` marks the original.  With blocks no shorter than the look-back,
    at most one copy is made, and only near the end of a block.
    """
    us = F.unix_micros(ts)
    lo, hi = block_of(us, block_s), block_of(us + micros(back_s), block_s)
    return (
        df.withColumn("_home", lo)
        .withColumn(BLOCK, F.explode(F.sequence(lo, hi)))
        .withColumn(CORE, F.col(BLOCK) == F.col("_home"))
        .drop("_home")
    )


def stitch(pieces: DataFrame, keys: Sequence[str], out: str = "_island") -> DataFrame:
    """Name the island every piece belongs to, by the head of its first piece.

    ``pieces`` has one row per (key, block, ``_seq``) with ``_head``, the order
    of its first row; ``_seq`` counts island starts within the block.  A block's
    leading piece (``_seq`` 0) goes to the last island begun in an earlier
    block; before the first island it is dropped.
    """
    begun = F.col("_seq") > 0
    opened = carry(pieces, keys, {"_open": F.max(F.when(begun, F.col("_head")))}, F.max)
    named = F.when(begun, F.col("_head")).otherwise(F.col("_open"))
    return join_carry(pieces, opened, keys).withColumn(out, named).drop("_open").where(F.col(out).isNotNull())
