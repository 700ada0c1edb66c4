"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The words of a test item that rarely occur side by side in the corpus are its seeds: a first pass counts every n-gram of the
items over all documents, and each item keeps the rarer part of its own n-grams, so an item always has seeds, however often its
passage was copied. A second pass finds the seeds in the documents; each hit opens a window around the place where the item
would lie, hits on nearby diagonals share one, and the window is aligned with the item word by word (match 1, mismatch and gap
-1). The best local score over the item's length, 1 for an exact copy, is the document's score for that item, so edited and
partly copied passages are found too.

The items are taken in blocks of at most about `BLOCK_WORDS` words, each sent to the tasks in one broadcast of bounded size, and
every block meets all documents: no document is shuffled. Defined results: null and empty texts match nothing; items of fewer
than `SEED` words have no seed and match nothing; repeated rows and repeated items give a row each; a null id is kept as it is;
an empty table on either side gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import bounded_batches, table, with_text, words_of
from storyloom.llm.registry import query

SEED = 3  # words of a seed
RARE_SHARE, LEAST_SEEDS = 0.6, 8  # the part of its n-grams, rarest first, that an item keeps, and how many at least
MIN_SCORE = 0.5
BLOCK_WORDS = 1_000_000
CELLS = 1 << 18  # of the alignment matrices that are held at once
SCHEMA = "doc_id long, item_id long, score double, seeds int, last_word long"
EDGE = re.compile(r"^\W+|\W+$")


def plain(words: list[str]) -> list[str]:
    return [EDGE.sub("", w) for w in words]


class Items(NamedTuple):
    """A block of test items: ids, word numbers with offsets, the numbers of the words, and seeds with their places."""

    ids: np.ndarray
    codes: np.ndarray
    offsets: np.ndarray
    numbers: dict[str, int]
    seeds: np.ndarray  # sorted
    place_offsets: np.ndarray
    place_items: np.ndarray
    place_at: np.ndarray


def _grams(codes: np.ndarray, offsets: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, owner, position) of every n-gram whose words are all known; keys number them in base `base`."""
    n = len(codes) - SEED + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ok = owner[:n] == owner[SEED - 1 :]
    for k in range(SEED):
        ok &= codes[k : n + k] >= 0
    at = np.flatnonzero(ok)
    key = np.zeros(len(at), dtype=np.int64)
    for k in range(SEED):
        key = key * base + codes[at + k]
    return key, owner[at], at - offsets[owner[at]]


def build(rows: list[tuple[int, str]], counts: dict[int, int] | None = None) -> Items:
    """Index a block of (item_id, text); with `counts` of the n-grams over the corpus, items keep their rarer n-grams."""
    ids = np.array([i for i, _ in rows], dtype=object)  # a null id stays null
    words = words_of(pa.array([t for _, t in rows], pa.string()))
    numbers: dict[str, int] = {}
    by_vocab = np.array([numbers.setdefault(w, len(numbers)) if w else -1 for w in plain(words.vocab.to_pylist())], dtype=np.int64)
    codes = by_vocab[words.codes] if len(words.codes) else words.codes
    owner = np.repeat(np.arange(len(ids)), np.diff(words.offsets))
    real = codes >= 0
    offsets = np.concatenate([[0], np.cumsum(real)])[words.offsets]
    codes, owner = codes[real], owner[real]
    key, item, at = _grams(codes, offsets, max(1, len(numbers)))
    if counts is not None and len(key):
        seen = np.array([counts.get(k, 0) for k in key.tolist()])
        order = np.lexsort((at, seen, item))
        begin = np.searchsorted(item[order], np.arange(len(ids)))
        rank = np.arange(len(order)) - begin[item[order]]
        total = np.bincount(item, minlength=len(ids))[item[order]]
        kept = np.sort(order[rank < np.maximum(LEAST_SEEDS, np.ceil(RARE_SHARE * total))])
        key, item, at = key[kept], item[kept], at[kept]
    order = np.argsort(key, kind="stable")
    seeds, begin = np.unique(key[order], return_index=True)
    return Items(ids, codes, offsets, numbers, seeds, np.append(begin, len(key)), item[order], at[order])


def _hits(items: Items, texts: pa.Array) -> tuple:
    """(codes, offsets, seed, owner, position): the texts in the items' word numbers, and where seeds occur in them."""
    words = words_of(texts)
    get = items.numbers.get
    known = np.fromiter((get(w, -1 if w else -2) for w in plain(words.vocab.to_pylist())), np.int64, len(words.vocab))
    codes = known[words.codes] if len(words.codes) else words.codes
    real = codes != -2  # a token of punctuation only is no word
    offsets = np.concatenate([[0], np.cumsum(real)])[words.offsets]
    codes = codes[real]
    key, owner, at = _grams(codes, offsets, max(1, len(items.numbers)))
    seed = np.searchsorted(items.seeds, key)
    hit = (seed < len(items.seeds)) & (items.seeds[np.minimum(seed, max(0, len(items.seeds) - 1))] == key) if len(items.seeds) else np.zeros(len(key), dtype=bool)
    return codes, offsets, seed[hit], owner[hit], at[hit]


def align(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best local score, its last column) of each row of `a` against the same row of `b`; codes below zero match nothing.
    A gap along `b` is a running maximum, so a whole row of the matrix is one step."""
    n, width = b.shape
    h, best, last = np.zeros((n, width + 1)), np.zeros(n), np.zeros(n, dtype=np.int64)
    ramp = np.arange(width, dtype=np.float64)
    for k in range(a.shape[1]):
        same = (b == a[:, k, None]) & (b >= 0)
        t = np.maximum(np.where(same, h[:, :-1] + 1, h[:, :-1] - 1), h[:, 1:] - 1)
        np.maximum(t, 0, out=t)
        h[:, 1:] = np.maximum.accumulate(t + ramp, axis=1) - ramp
        top = h[:, 1:].argmax(axis=1)
        value = h[np.arange(n), top + 1]
        last = np.where(value > best, top, last)
        best = np.maximum(best, value)
    return best, last


def _windows(items: Items, offsets: np.ndarray, seed: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows (document, item, begin, end, seeds) to align: hits of a document and item whose diagonals lie close share one."""
    n = items.place_offsets[seed + 1] - items.place_offsets[seed]
    hit = np.repeat(np.arange(len(seed)), n)
    place = items.place_offsets[seed][hit] + np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n)
    doc, item = owner[hit], items.place_items[place]
    diagonal = at[hit] - items.place_at[place]
    order = np.lexsort((diagonal, item, doc))
    doc, item, diagonal = doc[order], item[order], diagonal[order]
    size = np.diff(items.offsets)[item]
    margin = np.maximum(8, size // 2)
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > margin[1:])
    first = np.flatnonzero(new)
    if not len(first):
        return np.zeros((0, 5), dtype=np.int64)
    final = np.append(first[1:], len(doc)) - 1
    length = np.diff(offsets)[doc[first]]
    begin = np.maximum(0, diagonal[first] - margin[first])
    end = np.minimum(length, diagonal[final] + size[final] + margin[final])
    return np.stack([doc[first], item[first], begin, end, final - first + 1], axis=1)


def matches(items: Items, texts: pa.Array, min_score: float) -> list[tuple[int, int, float, int, int]]:
    """(text, item, score, seeds, last word) of every text and item that align well enough, the best window of each."""
    codes, offsets, *found = _hits(items, texts)
    windows = _windows(items, offsets, *found)
    sizes = np.diff(items.offsets)
    best: dict[tuple[int, int], tuple] = {}
    windows = windows[np.lexsort((windows[:, 3] - windows[:, 2], sizes[windows[:, 1]]))]  # like sizes together
    k = 0
    while k < len(windows):
        wide = int(max(windows[k, 3] - windows[k, 2], 1))
        part = windows[k : k + max(1, CELLS // (2 * wide))]
        part = part[: max(1, np.searchsorted(sizes[part[:, 1]], 2 * sizes[part[0, 1]] + 1))]
        k += len(part)
        a = np.full((len(part), sizes[part[:, 1]].max()), -2)
        b = np.full((len(part), (part[:, 3] - part[:, 2]).max()), -1)
        for r, (doc, item, begin, end, _) in enumerate(part.tolist()):
            own = items.codes[items.offsets[item] : items.offsets[item + 1]]
            a[r, : len(own)] = own
            b[r, : end - begin] = codes[offsets[doc] + begin : offsets[doc] + end]
        score, last = align(a, b)
        score = score / sizes[part[:, 1]]
        for r in np.flatnonzero(score >= min_score):
            doc, item, begin, _, seeds = part[r].tolist()
            row = (float(score[r]), seeds, begin + int(last[r]))
            best[doc, item] = max(best.get((doc, item), row), row)
    return [(doc, item, *row) for (doc, item), row in sorted(best.items())]


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The test items in blocks of about `BLOCK_WORDS` words, one block on the driver at a time."""
    items = items.filter("text is not null").select("item_id", "text")
    words = items.agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first().n or 0
    n = -(-words // BLOCK_WORDS)
    for k in range(n):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        if rows := sorted(((r.item_id, r.text) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])):
            yield rows


def rare_seeds(docs: DataFrame, items: DataFrame) -> Iterator:
    """Each block of items with the seeds that are rare in `docs(text)`, as a broadcast."""
    spark = docs.sparkSession
    for rows in _blocks(items):
        every = spark.sparkContext.broadcast(build(rows))

        def count(batches: Iterator[pa.RecordBatch], every=every) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(every.value.seeds), dtype=np.int64)
            for batch in batches:
                total += np.bincount(_hits(every.value, batch.column("text"))[2], minlength=len(total))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(every.value.seeds[some]), pa.array(total[some])], names=["seed", "n"])

        seen = docs.select("text").mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
        yield spark.sparkContext.broadcast(build(rows, {r.seed: r.n for r in seen.collect()}))  # at most the block's n-grams


def without_leaks(docs: DataFrame, items: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of `docs`, all columns, that hold no copy of a test item."""
    bounded_batches(docs.sparkSession)
    texts = with_text(docs)
    for rare in rare_seeds(texts, items):

        def clean(batches: Iterator[pa.RecordBatch], rare=rare) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[d for d, *_ in matches(rare.value, batch.column("text"), min_score)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def find_leaks(docs: DataFrame, items: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """(doc_id, item_id, score, seeds, last_word) of every document that holds a copy, whole or edited, of a test item."""
    spark = bounded_batches(docs.sparkSession)
    docs = with_text(docs)
    out = spark.createDataFrame([], SCHEMA)
    for rare in rare_seeds(docs, items):

        def find(batches: Iterator[pa.RecordBatch], rare=rare) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = matches(rare.value, batch.column("text"), min_score)
                doc = pa.array([d for d, *_ in got], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(doc), pa.array(rare.value.ids[np.array([i for _, i, *_ in got], dtype=np.int64)], pa.int64()),
                     pa.array([s for *_, s, _, _ in got], pa.float64()), pa.array([n for *_, n, _ in got], pa.int32()),
                     pa.array([w for *_, w in got], pa.int64())],
                    names=["doc_id", "item_id", "score", "seeds", "last_word"])

        out = out.unionByName(docs.mapInArrow(find, SCHEMA))
    return out


@query("op7_decontamination")
def op7_decontamination(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
