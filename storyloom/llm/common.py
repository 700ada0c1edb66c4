"""What the training-data operators share: table readers, word columns inside Arrow batches, bounded samples."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS, ARROW_BYTES = 1024, 16 << 20


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Arrow batches of a bounded number of rows and bytes, so that very long texts never meet in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of an input table; columns the table has beyond these never reach the operator."""
    return bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def with_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with null texts as empty ones."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def fold(key: Column, n: int = 5) -> Column:
    """The fold of a row: crc32 of its key as text, modulo n."""
    return F.crc32(key.cast("string").cast("binary")) % n


class Words(NamedTuple):
    """Words of the texts of a batch: text i has codes[offsets[i]:offsets[i + 1]], positions in `vocab`."""

    offsets: np.ndarray
    codes: np.ndarray
    vocab: pa.Array


def words_of(texts: pa.Array, lower: bool = True) -> Words:
    """Split at ASCII white space and give each distinct word a number, all in C++: Python then sees distinct words only.
    `lower` folds A-Z alone. Nulls have no words."""
    texts = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    offsets = np.asarray(parts.offsets, dtype=np.int64)
    coded = parts.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    offsets = offsets - offsets[0]
    codes, vocab = np.asarray(coded.indices), coded.dictionary
    blank = pc.index(vocab, pa.scalar("", vocab.type)).as_py()
    if blank >= 0:  # from white space at either end
        real = codes != blank
        before = np.concatenate([[0], np.cumsum(real)])
        offsets, codes = before[offsets], codes[real]
    return Words(offsets, codes.astype(np.int64, copy=False), vocab)


def sums_by(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of consecutive slices, zero for empty ones."""
    run = np.concatenate([np.zeros((1, *values.shape[1:]), dtype=np.float64), np.cumsum(values, axis=0, dtype=np.float64)])
    return run[offsets[1:]] - run[offsets[:-1]]


def in_share(keys: list[str], wanted: Column, total: Column) -> Column:
    """Whether a row is among about `wanted` of `total` rows, by a hash of its keys: a sample without a sort, the same on every run."""
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return place < wanted / total


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int, skip_fold: int = 0) -> DataFrame:
    """About `bound` labelled texts of each class, or all there are, for fitting, as (doc_id, text, y); rows of fold `skip_fold` are held
    out. `bound` is the documented size of the sample, chosen by a hash of the id, so that the sample is the same on every
    run and spreads over the table. Rows that repeat an id count once."""
    marked = (
        labels.filter(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
        .filter((fold(F.col("doc_id")) != skip_fold) & F.col("doc_id").isNotNull())
    )
    sizes = {r.y: r.n for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = F.when(F.col("y") == 1, sizes.get(1, 1)).otherwise(sizes.get(0, 1))
    ids = marked.filter(in_share(["doc_id"], F.lit(bound), total))
    rows = with_text(docs).join(F.broadcast(ids), "doc_id")  # bounded: about two times `bound` rows of two numbers
    return rows.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("y").alias("y"))


def distinct_sample(rows: Iterable) -> list:
    """The rows (doc_id, text, y) in order of their ids; those that repeat a text count once."""
    seen, out = set(), []
    for doc_id, text, y in sorted(rows, key=lambda r: r[0]):
        if (text, y) not in seen:
            seen.add((text, y))
            out.append((doc_id, text, y))
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, skip_fold: int = 0) -> list:
    """`labelled_rows` on the driver, those that repeat a text once."""
    return distinct_sample((r.doc_id, r.text, r.y) for r in labelled_rows(docs, labels, label, bound, skip_fold).toLocalIterator())


def fitted(rows: DataFrame, fit: Callable[[list], Any]) -> Any:
    """The model that `fit` makes of a bounded sample (doc_id, text, y), fitted in one task: texts and working memory stay off the
    driver, and a lost executor costs one more try."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = distinct_sample(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "y"))))
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(fit(sample))], pa.binary())})

    made = rows.select("doc_id", "text", "y").repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(made.model) if made else fit([])  # without a row there is no task
