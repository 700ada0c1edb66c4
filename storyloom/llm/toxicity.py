"""Toxic spans by a linear-chain conditional random field.

Two states, toxic and other. A token's emission is the sum of the weights of its word, its prefixes of four and five letters
and its suffix of three; transitions couple neighbours. Labels exist for documents only, so the labelled tokens are made
first: a greedy cover picks the features that explain the most toxic documents while rare in clean ones, near copies
counted once, and tokens of toxic documents that carry one are labelled toxic. The field is fitted by gradient on the
conditional likelihood. Scoring runs forward and backward over all tokens of a batch at once; the marginals give the
offending offsets, and a logistic layer over the two highest marginals and the expected number of toxic tokens the document score.

Fitting reads about `SAMPLE` labelled documents of a class; all documents are scored whole, nothing but rows and their
scores leaves a task. Defined results: null and empty texts get the score of a text without tokens; repeated rows are scored
each; a null id is kept, and is not held out; without any labelled text of both classes every score is 0.5 of the prior, 0.0.
Other columns of the tables are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import bounded_batches, fitted, fold, labelled_rows, sums_by, table, with_text, words_of
from storyloom.llm.registry import query

SAMPLE = 1500  # labelled documents of each class used for fitting
WINDOW, WINDOWS, EPOCHS = 48, 3000, 30
COVER, MIN_GAIN, GAIN_SHARE = 3, 4, 0.02  # times a toxic document is to be explained; least documents a feature must add
LEAK = 0.25  # a feature's highest rate in clean documents, against its rate in toxic ones
CLEAN_WEIGHT = 3.0  # of clean documents in the layer above the field: a filter should keep them
SCHEMA = "doc_id long, score double, predicted int, n_spans int, spans array<struct<start:long,end:long,marginal:double>>"
EDGE = re.compile(r"^\W+|\W+$")


def features(word: str) -> tuple[str, ...]:
    """The word itself, its prefixes of four and five letters, its suffix of three."""
    w = EDGE.sub("", word.lower())
    out = ["w " + w] if w else []
    if len(w) > 5:
        out += ["p " + w[:5], "p " + w[:4], "s " + w[-3:]]
    elif len(w) > 4:
        out += ["p " + w[:4], "s " + w[-3:]]
    return tuple(out)


def _collapsed(docs: list[list[str]]) -> list[int]:
    """A group number per document: documents that share a smallest hash of their four-word shingles are near copies."""
    group, seen = list(range(len(docs))), {}
    for i, ws in enumerate(docs):
        if len(ws) < 8:
            continue
        hashes = np.array([crc32(" ".join(ws[k : k + 4]).encode()) for k in range(len(ws) - 3)], dtype=np.uint64)
        for seed in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F):
            key = (seed, int((hashes * np.uint64(seed) % np.uint64(4294967291)).min()))
            group[i] = min(group[i], seen.setdefault(key, group[i]))
    return group


def _lexicon(toxic: list[set], clean: list[set]) -> set[str]:
    """Features picked by greedy cover of the toxic documents."""
    inside, outside = defaultdict(list), Counter()
    for i, fs in enumerate(toxic):
        for f in fs:
            inside[f].append(i)
    for fs in clean:
        outside.update(f for f in fs if f in inside)
    rate, least = max(1, len(toxic)) / max(1, len(clean)), max(MIN_GAIN, GAIN_SHARE * len(toxic))
    open_, need, picked = {f: v for f, v in inside.items() if len(v) >= least and outside[f] * rate <= LEAK * len(v)}, np.full(len(toxic), COVER), set()
    while open_:
        gains = {f: sum(need[i] > 0 for i in v) for f, v in open_.items()}
        best = max(gains, key=lambda f: (gains[f], f))
        if gains[best] < least:
            break
        picked.add(best)
        need[open_.pop(best)] -= 1
        open_ = {f: v for f, v in open_.items() if gains[f] >= least}
    return picked


class Field:
    """Weights of the fitted field and of the layer above it."""

    def __init__(self, weights: dict[str, float], bias: float, trans: np.ndarray, init: np.ndarray, top: np.ndarray):
        self.weights, self.bias, self.trans, self.init, self.top = weights, bias, trans, init, top

    def emissions(self, vocab: list[str]) -> np.ndarray:
        get = self.weights.get
        return np.clip(np.fromiter((self.bias + sum(get(f, 0.0) for f in features(w)) for w in vocab), float, len(vocab)), -30, 30)

    def marginals(self, emission: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The probability that each token is toxic, by forward-backward over the concatenated texts. The stream is cut into
        rows; a first pass gives each row's transfer matrix, so all rows can then run side by side from exact messages."""
        n = len(emission)
        if not n:
            return np.zeros(0)
        steps = max(1, int(np.sqrt(n / 4)))
        rows = -(-n // steps)
        first = np.zeros(rows * steps, dtype=bool)
        first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        odds = np.ones(rows * steps)
        odds[:n] = np.exp(emission)
        fwd = _messages(odds.reshape(rows, steps), first.reshape(rows, steps), self.trans, self.init, after=False)
        # backward over the reversed stream: the message into a token comes from the one after it
        last = np.zeros(rows * steps, dtype=bool)
        last[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = True
        back = _messages(odds[::-1].reshape(rows, steps), last[::-1].reshape(rows, steps), self.trans.T, np.array([0.5, 0.5]), after=True)
        f, g = fwd.ravel()[:n], back.ravel()[::-1][:n]
        yes, no = f * g, (1 - f) * (1 - g)
        return yes / (yes + no)

    def scores(self, marginals: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(document_features(marginals, offsets) @ self.top, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def document_features(p: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One, the logits of the highest and the second marginal, and the log of the expected number of toxic tokens."""
    n, full, starts = len(offsets) - 1, offsets[:-1] < offsets[1:], offsets[:-1]
    best, second, rest = np.zeros(n), np.zeros(n), p.copy()
    if full.any():
        best[full] = np.maximum.reduceat(p, starts[full])
        top = np.flatnonzero(p == np.repeat(best, np.diff(offsets)))
        owner = np.repeat(np.arange(n), np.diff(offsets))[top]
        rest[top[np.concatenate([[True], owner[1:] != owner[:-1]])]] = 0  # one of them, where several are highest
        second[full] = np.maximum.reduceat(rest, starts[full])
    return np.stack([np.ones(n), _logit(best), _logit(second), np.log1p(sums_by(p, offsets))], axis=1)


def _messages(odds: np.ndarray, first: np.ndarray, t: np.ndarray, init: np.ndarray, after: bool) -> np.ndarray:
    """Normalised chance of the toxic state at each token. Forward: transition, then this token's odds. `after`: the message
    that reaches a token from beyond it, i.e. that token's own odds are applied only when it is passed on."""
    rows, steps = odds.shape
    o, s = np.ascontiguousarray(odds.T), np.ascontiguousarray(first.T)

    def step(a0, a1, k):
        n0, n1 = a0 * t[0, 0] + a1 * t[1, 0], a0 * t[0, 1] + a1 * t[1, 1]
        if s[k].any():
            total = a0 + a1
            n0, n1 = np.where(s[k], total * init[0], n0), np.where(s[k], total * init[1], n1)
        return n0, n1

    lo, hi = (np.ones(rows), np.zeros(rows)), (np.zeros(rows), np.ones(rows))
    for k in range(steps):
        new = []
        for a in (lo, hi):
            n0, n1 = step(*a, k)
            new.append((n0, n1 * o[k]))
        scale = new[0][0] + new[0][1] + new[1][0] + new[1][1]
        lo, hi = ((a / scale, b / scale) for a, b in new)
    v0, v1, begin0, begin1 = 0.5, 0.5, np.empty(rows), np.empty(rows)
    for r in range(rows):
        begin0[r], begin1[r] = v0, v1
        w0, w1 = v0 * lo[0][r] + v1 * hi[0][r], v0 * lo[1][r] + v1 * hi[1][r]
        v0, v1 = w0 / (w0 + w1), w1 / (w0 + w1)
    a0, a1, out = begin0, begin1, np.empty((steps, rows))
    for k in range(steps):
        n0, n1 = step(a0, a1, k)
        m1 = n1 * o[k]
        out[k] = n1 / (n0 + n1) if after else m1 / (n0 + m1)
        scale = n0 + m1
        a0, a1 = n0 / scale, m1 / scale
    return out.T


def fit(sample: list) -> Field | None:
    """Fit the field on (doc_id, text, y) rows; None if a class is missing."""
    one: dict[str, str] = {}  # equal words share one string
    docs, ys = [[one.setdefault(w, w) for w in t.lower().split()] for _, t, _ in sample], [y for *_, y in sample]
    if len(set(ys)) < 2:
        return None
    group = _collapsed(docs)
    keep = [i for i in range(len(docs)) if group[i] == i]
    cache: dict[str, tuple] = {}
    feats = lambda w: cache[w] if w in cache else cache.setdefault(w, features(w))
    held = lambda i: {f for w in set(docs[i]) for f in feats(w) if f[0] != "s"}
    seen = Counter(f for i in keep if ys[i] for f in held(i))
    often = {f for f, n in seen.items() if n >= MIN_GAIN}  # the others cannot be picked
    del seen
    sets = {i: held(i) & often for i in keep}
    lexicon = _lexicon([sets[i] for i in keep if ys[i]], [sets[i] for i in keep if not ys[i]])
    del sets
    rng = np.random.default_rng(7)
    windows, marks = [], []
    for i in keep:
        ws = docs[i]
        if not ws:
            continue
        if ys[i]:
            hit = [k for k, w in enumerate(ws) if not lexicon.isdisjoint(feats(w))]
            starts = sorted({max(0, min(k - int(rng.integers(0, WINDOW)), len(ws) - WINDOW)) for k in hit[:6]})
        else:
            hit, starts = [], [int(rng.integers(0, max(1, len(ws) - WINDOW))) for _ in range(3)]
        hits = set(hit)
        for a in starts:
            windows.append(ws[a : a + WINDOW])
            marks.append([k in hits for k in range(a, min(a + WINDOW, len(ws)))])
    order = rng.permutation(len(windows))[: 2 * WINDOWS]
    windows, marks = [windows[k] for k in order], [marks[k] for k in order]
    weights, bias, trans, init = _train(windows, marks, feats)
    field = Field(weights, bias, trans, init, np.zeros(4))
    offsets = np.concatenate([[0], np.cumsum([len(docs[i]) for i in keep])])
    x = document_features(field.marginals(field.emissions([w for i in keep for w in docs[i]]), offsets), offsets)
    y, top = np.array([ys[i] for i in keep], dtype=float), np.zeros(4)
    each = np.where(y == 1, 1 / max(1, y.sum()), CLEAN_WEIGHT / max(1, (1 - y).sum()))
    for _ in range(60):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ top, -30, 30)))
        grad = x.T @ (each * (p - y)) + 1e-4 * top
        top = top - np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(4), grad)
    field.top = top
    return field


def _train(windows: list, marks: list, feats) -> tuple[dict, float, np.ndarray, np.ndarray]:
    """Gradient ascent on the conditional likelihood of the windows, all of them side by side."""
    counts = Counter(f for ws in windows for w in ws for f in feats(w))
    index = {f: k for k, f in enumerate(sorted(f for f, c in counts.items() if c >= 2))}
    n, cols = len(windows), 4
    ids = np.full((n, WINDOW, cols), len(index))
    y, real = np.zeros((n, WINDOW)), np.zeros((n, WINDOW), dtype=bool)
    for r, (ws, m) in enumerate(zip(windows, marks)):
        real[r, : len(ws)], y[r, : len(ws)] = True, m
        for k, w in enumerate(ws):
            known = [index[f] for f in feats(w) if f in index]
            ids[r, k, : len(known)] = known
    # state scores: emission e of the toxic state, transition scores q of shape (2, 2), start score b0 for the toxic state
    w, bias, q, b0 = np.zeros(len(index) + 1), np.array(-2.0), np.zeros((2, 2)), np.array(-2.0)
    m, v = [np.zeros_like(x) for x in (w, bias, q, b0)], [np.zeros_like(x) for x in (w, bias, q, b0)]
    states = y.astype(int)
    pairs_real = real[:, 1:]
    for epoch in range(1, EPOCHS + 1):
        e = w[ids].sum(axis=2) + bias
        a = np.empty((n, WINDOW, 2))
        a[:, 0] = np.stack([np.zeros(n), b0 + e[:, 0]], axis=1)
        for k in range(1, WINDOW):
            s = np.logaddexp(a[:, k - 1, 0, None] + q[0], a[:, k - 1, 1, None] + q[1])
            s[:, 1] += e[:, k]
            a[:, k] = np.where(real[:, k, None], s, a[:, k - 1])
        b = np.zeros((n, WINDOW, 2))
        for k in range(WINDOW - 2, -1, -1):
            nxt = b[:, k + 1].copy()
            nxt[:, 1] += e[:, k + 1]
            s = np.logaddexp(nxt[:, 0, None] + q[:, 0], nxt[:, 1, None] + q[:, 1])
            b[:, k] = np.where(real[:, k + 1, None], s, 0.0)
        z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        p = np.exp(a[:, :, 1] + b[:, :, 1] - z[:, None]) * real
        diff = (y - p) * real
        gq = np.empty((2, 2))
        for i in (0, 1):
            for j in (0, 1):
                pair = a[:, :-1, i] + q[i, j] + b[:, 1:, j] + (e[:, 1:] if j else 0) - z[:, None]
                seen = ((states[:, :-1] == i) & (states[:, 1:] == j) & pairs_real).sum()
                gq[i, j] = seen - np.exp(np.where(pairs_real, pair, -np.inf)).sum()
        gw = np.bincount(ids.ravel(), np.repeat(diff.ravel(), cols), len(w))
        gw[-1] = 0
        grads = [gw - 0.05 * w, diff.sum(), gq - 0.05 * q, diff[:, 0].sum()]
        for k, (g, x) in enumerate(zip(grads, (w, bias, q, b0))):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            x += 0.25 * (m[k] / (1 - 0.9**epoch)) / (np.sqrt(v[k] / (1 - 0.99**epoch)) + 1e-8)
    t = np.exp(q)
    start = np.array([1.0, float(np.exp(b0))])
    return {f: float(w[k]) for f, k in index.items() if w[k]}, float(bias), t / t.sum(), start / start.sum()


def without_toxic(docs: DataFrame, field: Field | None) -> DataFrame:
    """The rows of `docs`, all columns, whose text the field does not reject."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared.value is None:
                yield batch
                continue
            words = words_of(batch.column("text"), lower=True)
            p = shared.value.marginals(shared.value.emissions(words.vocab.to_pylist())[words.codes], words.offsets)
            yield batch.filter(pa.array(shared.value.scores(p, words.offsets) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def tag_toxic(docs: DataFrame, field: Field | None) -> DataFrame:
    """One row per document of `docs`: (doc_id, score, predicted, n_spans, spans); spans are code point offsets, end exclusive,
    of tokens that are more likely toxic than not."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            n = batch.num_rows
            score, spans = np.zeros(n), [[] for _ in range(n)]
            if model is not None:
                words = words_of(batch.column("text"), lower=True)
                p = model.marginals(model.emissions(words.vocab.to_pylist())[words.codes], words.offsets)
                score = model.scores(p, words.offsets)
                owners = np.repeat(np.arange(n), np.diff(words.offsets))
                for i in np.unique(owners[p > 0.5]):
                    own = p[words.offsets[i] : words.offsets[i + 1]]
                    found = re.finditer(r"[^\x20\x09-\x0D]+", batch.column("text")[i].as_py())
                    spans[i] = [{"start": m.start(), "end": m.end(), "marginal": float(q)} for m, q in zip(found, own) if q > 0.5]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)),
                 pa.array([len(s) for s in spans], pa.int32()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())])))],
                names=["doc_id", "score", "predicted", "n_spans", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def toxic_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled documents of the folds 1 to 4, then tag every document."""
    bounded_batches(docs.sparkSession)
    docs = with_text(docs)
    field = fitted(labelled_rows(docs, labels, "toxic", SAMPLE), fit)
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return tag_toxic(docs, field).select("doc_id", held, "score", "predicted", "n_spans", "spans")


@query("op8_toxicity")
def op8_toxicity(spark, sf_dir):
    return toxic_scores(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))
