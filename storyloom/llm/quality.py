"""Quality of documents: random-indexing word vectors pooled per document, then a small neural network.

A token has two units: its word in lower case if the sample knows it, and its shape (case, digits, marks at the end, whether it
repeats a word just before). Every unit has a sparse random index vector, drawn from its hash; a unit's context vector is the sum
of the index vectors of the units around its occurrences, so units used alike are close. A document is the mean of its tokens'
vectors, with the share of distinct words and the length beside it. A network with one hidden layer, trained in numpy, gives a
logit, and a temperature fitted on labelled documents kept out of training turns it into a calibrated probability.

Fitting, of vectors and network, reads about `SAMPLE` labelled documents of a class; every document is scored whole. Defined
results: null and empty texts get the score of a text without tokens; repeated rows are scored each; a null id is kept, and is not
held out; without labelled texts of both classes every score is 0.5; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import Words, bounded_batches, fold, labelled_sample, sums_by, table, with_text, words_of
from storyloom.llm.registry import query

SAMPLE, LEAST = 1500, 5  # labelled documents of a class used for fitting; occurrences of a word that gets a vector
DIM, ONES, REACH = 64, 4, 2  # length of a vector, entries of an index vector that are not zero, words looked at on either side
HIDDEN, EPOCHS, RATE, DECAY = 24, 300, 0.02, 1e-3
STRETCH = 200_000  # tokens whose vectors are held at once while fitting
EDGE = re.compile(r"^\W+|\W+$")
MARKS = re.compile(r"\W+$")
SCHEMA = "doc_id long, score double, predicted int"
THRESHOLD = 0.3


def shape(token: str) -> str:
    """Case, digits and the marks at the end of a token, runs of a mark as two."""
    w = EDGE.sub("", token)
    end = MARKS.search(token)
    marks = re.sub(r"(.)\1+", r"\1\1", end.group())[:4] if end else ""
    if not w:
        kind = "marks"
    elif any(c.isdigit() for c in w):
        kind = "digits"
    elif w.islower():
        kind = "lower"
    elif w.isupper() and len(w) > 1:
        kind = "upper"
    else:
        kind = "title" if w[1:].islower() or len(w) == 1 else "mixed"
    return f"{kind} {min(len(w), 20) // 7} {marks}"


def index_vector(unit: str) -> np.ndarray:
    """Sparse and ternary, the same for a unit everywhere."""
    out, state = np.zeros(DIM), crc32(unit.encode())
    for k in range(ONES):
        state = crc32(state.to_bytes(4, "little"), k)
        out[state % DIM] += 1 if state >> 16 & 1 else -1
    return out


class Vectors:
    """Units known from the sample, with one row of `rows` each; the first row is that of unknown words, the second marks a repeat."""

    def __init__(self, texts: list[str]):
        words = words_of(pa.array(texts, pa.string()), lower=False)
        vocab = words.vocab.to_pylist()
        counts = np.bincount(words.codes, minlength=len(vocab))
        known: Counter = Counter()
        for w, n in zip(vocab, counts.tolist()):
            known["w " + EDGE.sub("", w.lower())] += n
            known["s " + shape(w)] += n
        names = ["?", "repeat"] + sorted(u for u, n in known.items() if n >= LEAST)
        self.number = {u: k for k, u in enumerate(names)}
        index = np.stack([index_vector(u) for u in names])
        units, repeats = self.units(words)
        context = np.zeros_like(index)
        owner = np.repeat(np.arange(len(texts)), np.diff(words.offsets))
        for a in range(0, len(owner), STRETCH):  # memory for a stretch of tokens, however long the sample
            z = slice(a, min(a + STRETCH + REACH, len(owner)))
            own = index[units[0][z]] + index[units[1][z]] + repeats[z, None] * index[1]
            for away in range(1, REACH + 1):
                same = np.flatnonzero(owner[z][away:] == owner[z][:-away])
                same = same[same < STRETCH]  # a pair belongs to the stretch of its first token
                for here, there in ((same, same + away), (same + away, same)):
                    for side in units:
                        for d in range(DIM):
                            context[:, d] += np.bincount(side[z][here], own[there, d], len(names))
        length = np.linalg.norm(context, axis=1, keepdims=True)
        self.rows = (index / np.sqrt(ONES) + context / np.maximum(length, 1e-9)).astype(np.float32)

    def units(self, words: Words) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        """Numbers of the word and the shape of every token, and whether it repeats one of the two words before it."""
        get, vocab = self.number.get, words.vocab.to_pylist()
        word = np.fromiter((get("w " + EDGE.sub("", w.lower()), 0) for w in vocab), np.int64, len(vocab))
        form = np.fromiter((get("s " + shape(w), 0) for w in vocab), np.int64, len(vocab))
        c = words.codes
        owner = np.repeat(np.arange(len(words.offsets) - 1), np.diff(words.offsets))
        repeat = np.zeros(len(c), dtype=bool)
        for away in (1, 2):
            repeat[away:] |= (c[away:] == c[:-away]) & (owner[away:] == owner[:-away])
        return (word[c], form[c]) if len(c) else (c, c), repeat

    def pooled(self, texts: pa.Array) -> np.ndarray:
        """A row per text: the mean vector, the share of repeats, the share of distinct words, the log of the length."""
        words = words_of(texts, lower=False)
        (word, form), repeat = self.units(words)
        n = np.diff(words.offsets)
        docs, size = len(n), len(self.rows)
        owner = np.repeat(np.arange(docs), n)
        mean = np.zeros((docs, DIM))
        for k in range(0, docs, 128):  # counts of units by document, then one product with the vectors
            a, z = words.offsets[k], words.offsets[min(k + 128, docs)]
            rows = min(128, docs - k)
            at = (owner[a:z] - k) * size
            counts = np.bincount(at + word[a:z], minlength=rows * size) + np.bincount(at + form[a:z], minlength=rows * size)
            mean[k : k + rows] = counts.reshape(rows, size).astype(np.float32) @ self.rows
        per = np.maximum(n, 1)
        distinct = np.unique(owner * max(1, len(words.vocab)) + words.codes) // max(1, len(words.vocab)) if len(owner) else owner
        return np.column_stack([mean / per[:, None], sums_by(repeat.astype(float), words.offsets) / per, np.bincount(distinct, minlength=docs) / per, np.log1p(n)])


class Network:
    """Two layers on standardised features; `temperature` divides the logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        rng = np.random.default_rng(1)
        held = np.arange(len(x)) % 5 == 0
        self.w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        z, t = (x[~held] - self.mean) / self.scale, y[~held]
        m, v = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w]
        for step in range(1, EPOCHS + 1):
            h = np.tanh(z @ self.w[0] + self.w[1])
            d = (1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3], -30, 30))) - t) / len(t)
            back = np.outer(d, self.w[2]) * (1 - h * h)
            grads = [z.T @ back + DECAY * self.w[0], back.sum(axis=0), h.T @ d + DECAY * self.w[2], np.array([d.sum()])]
            for k, g in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                self.w[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        if held.any():
            logits, t = self.logits(x[held]), y[held]
            options = np.exp(np.linspace(np.log(0.5), np.log(8), 60))
            losses = [np.mean(np.logaddexp(0, logits / o) - t * logits / o) for o in options]
            self.temperature = float(options[int(np.argmin(losses))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(sample: list) -> tuple[Vectors, Network] | None:
    """Vectors and network from (doc_id, text, y) rows; None if a class is missing."""
    y = np.array([y for *_, y in sample], dtype=float)
    if len(set(y.tolist())) < 2:
        return None
    vectors = Vectors([t for _, t, _ in sample])
    parts = [vectors.pooled(pa.array([t for _, t, _ in sample[k : k + 256]], pa.string())) for k in range(0, len(sample), 256)]
    return vectors, Network(np.concatenate(parts), y)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; the folds 1 to 4 of the labels are learned from."""
    spark = bounded_batches(docs.sparkSession)
    docs = with_text(docs)
    shared = spark.sparkContext.broadcast(fit(labelled_sample(docs, labels, "quality", SAMPLE)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.full(batch.num_rows, 0.5)
            if shared.value is not None and batch.num_rows:
                vectors, network = shared.value
                score = network.scores(vectors.pooled(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA).select("doc_id", held, "score", "predicted")


@query("op9_quality")
def op9_quality(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))
