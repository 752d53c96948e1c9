"""What several operators share: words, training folds, blocks of documents, row-wise Arrow output."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType

from eventide.session import shared_dir, stage

__all__ = ["annotate", "answered", "blocked", "fold", "pack", "read", "shared_dir", "stage", "unpack", "words"]


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8, A-Z in lower case.

    ``bytes.lower`` and ``bytes.split`` know ASCII only: the letters A-Z and just these six kinds of white space.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids are in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(0).cast("bigint"))


def blocked(
    df: DataFrame, id_col: str, text_col: str, block_bytes: int, rows: int = 4096, others: tuple[str, ...] = ()
) -> DataFrame:
    """``df`` as a table bucketed by ``block``, ready for repeated look-ups by block.

    A block is a run of neighbouring rows of one input partition with about ``block_bytes`` bytes of text, or one
    longer text.  The table lies in the shared folder; bucketing lets every later exchange of answers meet the
    blocks where they are, so texts are never shuffled.  Columns: block long, row int (place in the block), id,
    text (empty for null), rest (struct of the columns ``others``; null without any).
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "stage", uuid.uuid4().hex)
    name = "llm_blocks_" + os.path.basename(path)
    rest = F.struct(*others) if others else F.lit(None).cast("string")
    source = df.select(
        F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), rest.alias("rest")
    )
    schema = StructType.fromDDL("block long, row int").fields + source.schema.fields

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, row = TaskContext.get().partitionId() << 32, 0, 0
        for b in batches:
            blocks, places = [], []
            for n in pa.compute.binary_length(b.column(1)).to_pylist():
                if row and (size + n > block_bytes or row >= rows):
                    block, size, row = block + 1, 0, 0
                blocks.append(block)
                places.append(row)
                size, row = size + n, row + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int64()), pa.array(places, pa.int32()), *b.columns], ["block", "row", "id", "text", "rest"]
            )

    numbered = source.mapInArrow(number, StructType(schema))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    numbered.write.option("path", path).option("compression", "zstd").bucketBy(buckets, "block").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalog's entry alone: the files are the folder's, and the plan knows them
    return table


def annotate(df: DataFrame, text_col: str, schema: str, fn, slice_rows: int = 256) -> DataFrame:
    """``df`` without ``text_col`` and with the columns of ``schema`` (DDL) that ``fn`` gives for its texts.

    ``fn(texts)`` takes a list of strings or None and returns one list or array for each new column.  Works on slices of
    an Arrow batch, so that Python holds few texts at a time; other columns pass through untouched, nulls included.
    """
    kept = [c for c in df.columns if c != text_col]
    new = StructType.fromDDL(schema)
    out = StructType([*(df.schema[c] for c in kept), *new.fields])
    types = [to_arrow_type(f.dataType) for f in new.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, slice_rows):
                part = b.slice(i, slice_rows)
                made = fn(part.column(b.schema.get_field_index(text_col)).to_pylist())
                arrays = [part.column(b.schema.get_field_index(c)) for c in kept]
                arrays += [pa.array(x, t) for x, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, [*kept, *new.names])

    return df.mapInArrow(run, out)


def answered(blocks: DataFrame, answers: DataFrame, fn, schema: StructType) -> DataFrame:
    """``fn(rows, answers)`` for every block of a :func:`blocked` table, rows in order; both are Arrow tables.

    The blocks stay where they lie; only the answers are dealt.
    """
    empty = schema_table(schema)

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        return fn(rows.sort_by("row"), told) if rows.num_rows else empty

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def schema_table(schema: StructType) -> pa.Table:
    return to_arrow_schema(schema).empty_table()


def pack(*arrays: np.ndarray) -> bytes:
    """Some one-dimensional arrays as one compressed value."""
    head = ",".join(f"{a.dtype.str}{len(a)}" for a in arrays).encode()
    body = b"".join([len(head).to_bytes(4, "little"), head, *(np.ascontiguousarray(a).tobytes() for a in arrays)])
    return zstandard.ZstdCompressor(level=1).compress(body)


def unpack(value: bytes) -> list[np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(value)
    at = 4 + int.from_bytes(body[:4], "little")
    out = []
    for part in body[4:at].decode().split(","):
        kind = np.dtype(part[:3])
        n = int(part[3:])
        out.append(np.frombuffer(body, kind, n, at))
        at += n * kind.itemsize
    return out
