"""Cleans the documents table, one operator after the other; each stage is written before the next one reads it.

    language ID      rows whose language isn't recognised go (null and letterless texts, scores under the calibrated floor)
    near-dedup       of each group of near copies the row with the smallest id stays
    exact dedup      passages that stand in a document with a smaller id are cut out; rows left without text go
    decontamination  rows that give a test item away go
    BPE              ids of each text

All stages but the last return the columns of ``documents``; every stage takes a table without rows, null ids, repeated rows
and columns that documents doesn't have, which pass through.
"""

from __future__ import annotations

import os
import uuid

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm import bpe, decontaminate, factors, langid, simhash
from eventide.llm.common import answered, blocked, read, shared_dir, stage

ORACLE_SQL = None
TOKENIZER = "byte_bpe_50k.json"
BLOCK_BYTES = 8 << 20


def carried(docs: DataFrame) -> DataFrame:
    """Texts, and all other columns in one, so that no name can clash with what an operator adds."""
    return docs.select("text", F.struct(*[c for c in docs.columns if c != "text"]).alias("rest"))


def restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(c if c == "text" else f"rest.`{c}`").alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the rows that have a language; looks at the text alone to decide."""
    told = langid.identify(carried(docs), docs.select("doc_id", "text", "lang"))
    return restored(told.where("lang_ok"), docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest id, and of its repeated rows one.

    Rows that share an id are one document, which goes if any of them is a later copy of another document.  A group holds what fingerprints link, and what 0.8 or more of the five-word shingles link.  Documents without an id
    stay: nothing says which of them is first.
    """
    c = F.col
    whole = docs.withColumns({"_llm_id": c("doc_id"), "_llm_null": c("text").isNull()})
    others = tuple(n for n in whole.columns if n not in ("doc_id", "text"))
    blocks = blocked(whole, "doc_id", "text", BLOCK_BYTES, others=others)
    found = stage(simhash.near_duplicates(blocks, "id", "text", similarity=0.8, others=("block", "row"), in_blocks=True))
    place = F.struct("block", "row")
    said = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(c("doc_id") != c("component_id")).alias("later"), F.min(place).alias("first"))
    gone = found.join(said, "doc_id").where(c("later") | (place != c("first"))).select("block", "row")
    schema = blocks.select("id", "text", "rest").schema

    def keep(rows: pa.Table, told: pa.Table) -> pa.Table:
        stays = pc.invert(pc.is_in(rows.column("row"), told.column("row").combine_chunks()))
        return rows.select(["id", "text", "rest"]).filter(stays)

    left = answered(blocks, gone, keep, schema)
    text = F.when(~c("rest._llm_null"), c("text"))
    named = {"doc_id": c("rest._llm_id"), "text": text}
    return left.select(*[named.get(n, c("rest")[n]).alias(n) for n in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of 50 bytes and more are cut out of all documents but the first; half characters are dropped."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    cut = factors.without_repeats(docs, others=others, as_text=True)
    out = cut.where("n_removed = 0 OR length(kept) > 0").select(
        F.col("id").alias("doc_id"), F.col("kept").alias("text"), *[F.col(f"rest.{c}").alias(c) for c in others]
    )
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give a test item away go."""
    told = decontaminate.marked(carried(docs), read(spark, sf_dir, "benchmark"))
    return restored(told.where("size(leaks) = 0"), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of ids, the ids (little-endian unsigned 32-bit integers), and whether they decode to the text."""
    pairs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("input"), "text")
    out = bpe.round_trip(pairs, public_tokenizers.path(TOKENIZER))
    return out.select("doc_id", "n_tokens", "ids", (F.col("decoded") == F.col("input")).alias("round_trip"))


STAGES = [
    ("language", language),
    ("near", near),
    ("exact", exact),
    ("benchmark", benchmark),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what each keeps is written to the shared folder and read by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        path = os.path.join(shared_dir(spark), "pipeline", f"{name}-{uuid.uuid4().hex}")
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
