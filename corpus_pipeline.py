"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next.

Stages take (spark, docs, sf_dir); all but the last return the columns of `documents`. `docs` may hold nulls in any column,
repeated rows, empty and very long texts, and no rows at all; columns beyond those of `documents` are dropped at the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import decontaminate, packing, pii, simhash, toxicity
from storyloom.llm.common import fitted, labelled_rows, table
from storyloom.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the toxicity field does not reject; each row is judged by itself."""
    docs = docs.select(*COLUMNS)
    sample = labelled_rows(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"), "toxic", toxicity.SAMPLE)
    return toxicity.without_toxic(docs, fitted(sample, toxicity.fit))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: one with the smallest id, the first by content. Rows that share an id but hold different
    texts are judged by their texts. Rows without an id cannot stand for a group; they stay."""
    docs = docs.select(*COLUMNS)
    named = docs.filter("doc_id is not null")
    first = simhash.near_copies(named).filter("doc_id = component_id").select("doc_id", "text_key", "component").distinct()
    keyed = named.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    once = keyed.join(first, ["doc_id", "text_key"]).groupBy("doc_id", "component").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("row"))
    return once.select("doc_id", "row.*").unionByName(docs.filter("doc_id is null"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy, whole or edited, of a benchmark item; each row is judged by itself."""
    return decontaminate.without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark", "item_id", "text"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind; n_chars is that of the new text. A null text stays null."""
    docs = docs.select(*COLUMNS)
    spans = pii.personal_data(docs).filter("size(base) + size(added) > 0").select(
        F.col("doc_id").alias("id"), "text_key", F.concat("base", "added").alias("spans")).distinct()
    joined = docs.join(spans, docs.doc_id.eqNullSafe(spans.id) & (F.xxhash64("text") == spans.text_key), "left")
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(pii.masked(F.col("text"), F.col("spans")))
    return joined.select("doc_id", text.alias("text"), "lang", "source", "n_chars").withColumn(
        "n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document: its place in the packed sequences and the checksum of its ids."""
    packed = packing.pack(docs, packing.vocabulary(), payload="crc32")
    return packed.select("doc_id", "start", "length", F.col("payload").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each_group),
    ("decontamination", drop_leaks),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # a fitted field, a trie join, alignments and packing are not expressible; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of `sf_dir`; what each stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
