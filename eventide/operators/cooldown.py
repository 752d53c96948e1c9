"""Cooldown: accept a row if its key accepted nothing in the last ``c`` seconds.

The rule looks back to the last *accepted* row, so it is a chain.  Split in
time blocks, a block's answer depends only on where the chain enters it, and
that is within the first ``c`` seconds of the block (or at its first row after
those).  Three steps: every block maps each possible entry to the last row it
would accept; the chain is run over those short maps; every block is marked
from its true entry.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.operators import blocks
from eventide.operators.batches import whole_groups
from eventide.operators.blocks import BLOCK


FIRST = -(1 << 62)  # entry of a key's first block: its first row


def _jumps(us: np.ndarray, c: int) -> np.ndarray:
    """Index of the next row that may be accepted after each row."""
    return np.searchsorted(us, us + c, side="left")


def entry_map(us: np.ndarray, c: int, block_start: int) -> tuple[np.ndarray, np.ndarray]:
    """Breakpoints of the block's map from entry to the last accepted time: latest entry row of each outcome, and outcome.

    Different entries soon accept the same rows, so a block has few breakpoints however dense it is.
    """
    nxt, own = _jumps(us, c), np.arange(len(us))
    to = np.where(nxt < len(us), nxt, own)
    while not np.array_equal(to, further := to[to]):  # pointers double their reach
        to = further
    last = us[to]
    # entries are the rows inside the first c and the first row after; of neighbours with one outcome the last will do
    n = min(int(np.searchsorted(us, block_start + c, side="left")) + 1, len(us))
    rows = np.flatnonzero(np.append(last[1:n] != last[: n - 1], True))
    return rows, last[rows]


def accept(us: np.ndarray, c: int, enter: int) -> np.ndarray:
    """Accepted rows of a sorted block entered at the first row with time >= ``enter``."""
    ok = np.zeros(len(us), dtype=bool)
    nxt, i = _jumps(us, c).tolist(), int(np.searchsorted(us, enter, side="left"))
    while i < len(us):
        ok[i] = True
        i = nxt[i]
    return ok


def cooldown(
    df: DataFrame, keys: Sequence[str], seconds: float, block_s: float, ts: str = "ts", order: Sequence[str] = ()
) -> DataFrame:
    """Adds ``accepted``.  ``order`` breaks ties between rows of equal time.

    ``block_s`` must be at least ``seconds``.  Of rows with equal time at most
    one is accepted, so ``seconds`` must be positive.
    """
    if not 0 < seconds <= block_s:
        raise ValueError("need 0 < seconds <= block_s")
    c, size = blocks.micros(seconds), blocks.micros(block_s)
    keys = list(keys)
    b = blocks.with_block(df, block_s, ts).withColumn("_us", F.unix_micros(ts))
    key_fields = [b.schema[k] for k in keys]
    group = [*keys, BLOCK]

    def long(*names: str) -> list[T.StructField]:
        return [T.StructField(n, T.LongType()) for n in names]

    def sorted_by_group(rows: DataFrame, *more: str) -> DataFrame:
        return rows.repartition(*group).sortWithinPartitions(*group, *more)

    maps_schema = T.StructType(key_fields + long(BLOCK, "_in", "_out"))

    def to_maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, begins in whole_groups(batches, group):
            us, block = pdf["_us"].to_numpy(), pdf[BLOCK].to_numpy()
            rows, last = [], []
            for i, j in zip(begins, [*begins[1:], len(pdf)]):
                at, out = entry_map(us[i:j], c, int(block[i]) * size)
                rows.append(i + at)
                last.append(out)
            out = pdf.iloc[np.concatenate(rows)].rename(columns={"_us": "_in"})
            yield out.assign(_out=np.concatenate(last))

    maps = sorted_by_group(b.select(*group, "_us"), "_us").mapInPandas(to_maps, maps_schema)

    enter_schema = T.StructType(key_fields + long(BLOCK, "_enter"))

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # sorted by key, block, entry; carries one accepted time per key
        key, block, taken, ready = None, None, False, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                k, bl, enter, last = row[:-3], row[-3], row[-2], row[-1]
                if k != key:
                    key, block, ready = k, None, None
                if bl != block:
                    block, taken = bl, False
                if not taken and (ready is None or enter >= ready):
                    taken = True
                    out.append((*k, bl, FIRST if ready is None else ready))
                    ready = last + c
            yield pd.DataFrame(out, columns=[f.name for f in enter_schema.fields])

    entries = maps.repartition(*keys).sortWithinPartitions(*group, "_in").mapInPandas(chain, enter_schema)
    out_schema = T.StructType(df.schema.fields + [T.StructField("accepted", T.BooleanType())])
    names = [f.name for f in out_schema.fields]

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, begins in whole_groups(batches, group):
            us, enter = pdf["_us"].to_numpy(), pdf["_enter"].to_numpy()
            ok = np.zeros(len(pdf), dtype=bool)
            for i, j in zip(begins, [*begins[1:], len(pdf)]):
                if not pd.isna(enter[i]):
                    ok[i:j] = accept(us[i:j], c, int(enter[i]))
            yield pdf.assign(accepted=ok)[names]

    return sorted_by_group(b.join(entries, group, "left"), "_us", *order).mapInPandas(mark, out_schema)
