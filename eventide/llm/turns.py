"""Turns of conversations in order, and streams of sorted rows cut by conversation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = ("conv_id", "turn", "role", "text")
_PREFIX = 64  # characters of a role or text that decide about its partition


def in_order(rows: DataFrame) -> DataFrame:
    """Rows by conversation, turn, role and text, nulls first: partitions follow each other, rows are sorted inside.

    A conversation of any size is cut wherever a partition is full.  Partitions are told apart by prefixes of role and text, so
    the samples that find their borders stay small; prefixes order rows as the whole strings do, and equal ones meet.
    """
    role = F.substring("role", 1, _PREFIX)
    text = F.when(F.char_length("role") <= _PREFIX, F.substring("text", 1, _PREFIX))
    return rows.repartitionByRange("conv_id", "turn", role, text).sortWithinPartitions(*ORDER)


def listed(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, few of them in Python at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield from zip(*(c.to_pylist() for c in b.slice(i, rows).columns), strict=True)


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches."""
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
