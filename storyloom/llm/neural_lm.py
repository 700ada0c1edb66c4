"""Document scores by a log-bilinear language model, trained with noise-contrastive estimation.

The model predicts a token's symbol from the three symbols before it: their vectors, weighted by position, add up to a predicted
vector, whose product with each symbol's vector, plus a bias, is the symbol's score. Symbols are the most frequent words, the end, and
classes of all other words by a letter that tells languages apart (the first one beyond ASCII, else the last one); a word of a class
has its smoothed share of the class's count. Training tells tokens of the corpus from noise drawn by symbol frequency: a bounded
sample of documents gives the starting point, then every training document is read once, each task taking its own steps from
there, and the tasks' parameters are averaged by their tokens. Scoring multiplies the distinct contexts of a batch with all symbols
at once and normalises exactly, so the model is a distribution over words, unseen ones sharing one half count per class.

Corpus counts cover all training documents: words are counted in each batch, then summed in Spark. At most `HEAD` of the most
frequent counts are sent to the tasks; occurrences of rarer words are rows joined to their counts by word. Defined results: null and empty texts
are the end token alone; repeated rows are scored each; a null id counts as a training row; with no training rows counts are zero and
every token has the uniform base; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import bounded_batches, fold, in_share, sums_by, table, with_text, words_of
from storyloom.llm.registry import query
from storyloom.session import materialize

WORDS, CLASSES, HEAD = 192, 64, 400_000
CONTEXT, DIM, NOISE = 3, 16, 16
SAMPLE, EPOCHS = 1500, 3
STEP, RATE = 1024, 0.1  # tokens and rate of a step from scratch
LATER_STEP, LATER_RATE = 8192, 0.02  # and of one in the pass over all documents
END = "\n"  # no word holds white space
PAD = 0


class Lexicon(NamedTuple):
    """Symbols: 0 pads a context, then words (the end first), then classes, the last for letters that have none of their own."""

    words: list[str]
    letters: list[str]
    counts: np.ndarray  # of each symbol in the training tokens
    kinds: np.ndarray  # distinct words of each symbol
    head: pa.Array  # the most frequent words, the most frequent first
    head_counts: np.ndarray

    def symbols(self, vocab: list[str]) -> np.ndarray:
        number = {w: k + 1 for k, w in enumerate(self.words)}
        letter = {c: k + 1 + len(self.words) for k, c in enumerate(self.letters)}
        other = 1 + len(self.words) + len(self.letters)
        return np.fromiter((number.get(w) or letter.get(telling(w), other) for w in vocab), np.int64, len(vocab))


def telling(word: str) -> str:
    """The first character beyond ASCII, else the last one."""
    return word[-1:] if word.isascii() else next(c for c in word if c > "\x7f")


def stream(lexicon: Lexicon, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(symbols, offsets, codes, vocab): tokens of the texts with an end after each; code -1 is the end."""
    words = words_of(texts)
    of = lexicon.symbols(words.vocab.to_pylist())
    n = len(words.offsets) - 1
    codes = np.insert(words.codes, words.offsets[1:], -1)
    symbols = np.append(of, 1)[codes]  # the end is symbol 1
    return symbols, words.offsets + np.arange(n + 1), codes, words.vocab


def contexts(symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The CONTEXT symbols before each token, nearest first, padded at the start of a text."""
    place = np.arange(len(symbols)) - np.repeat(offsets[:-1], np.diff(offsets))
    return np.stack([np.where(place > k, np.roll(symbols, k + 1), PAD) for k in range(CONTEXT)], axis=1)


class LogBilinear:
    def __init__(self, counts: np.ndarray, seed: int = 3):
        n = len(counts) + 1  # with the pad
        rng = np.random.default_rng(seed)
        self.noise = (counts + 0.5) / (counts + 0.5).sum()
        self.params = [
            rng.normal(0, 0.1, (n, DIM)).astype(np.float32),  # vectors of context symbols
            np.ones((CONTEXT, DIM), np.float32) / CONTEXT,  # weights by position
            rng.normal(0, 0.1, (n, DIM)).astype(np.float32),  # vectors of predicted symbols
            np.append([0], np.log(self.noise)).astype(np.float32),
        ]
        self.squares = [np.full_like(p, 1e-7) for p in self.params]

    def predicted(self, ctx: np.ndarray) -> np.ndarray:
        e, c = self.params[:2]
        return sum(e[ctx[:, k]] * c[k] for k in range(CONTEXT))

    def train(self, symbols: np.ndarray, ctx: np.ndarray, size: int, rate: float, rng: np.random.Generator) -> None:
        """One pass in steps of `size` tokens in random order; a step's noise symbols are shared by its tokens."""
        order = rng.permutation(len(symbols))
        symbols, ctx = symbols.astype(np.int16), ctx.astype(np.int16)
        log_noise = np.append([0], np.log(NOISE * self.noise)).astype(np.float32)
        for a in range(0, len(order), size):
            at = order[a : a + size]
            y, x = symbols[at], ctx[at]
            e, c, q, b = self.params
            noise = rng.choice(len(self.noise), NOISE, p=self.noise) + 1
            r = self.predicted(x)
            qy = q[y]
            up = 1 - _sigmoid(np.einsum("ij,ij->i", r, qy) + b[y] - log_noise[y])
            down = -_sigmoid(r @ q[noise].T + b[noise] - log_noise[noise])
            dr = up[:, None] * qy + down @ q[noise]
            dq, db, de = np.zeros_like(q), np.zeros_like(b), np.zeros_like(e)
            _add(dq, y, up[:, None] * r)
            np.add.at(dq, noise, down.T @ r)
            db += np.bincount(y, up, len(b)).astype(np.float32)
            np.add.at(db, noise, down.sum(axis=0))
            dc = np.empty_like(c)
            for k in range(CONTEXT):
                _add(de, x[:, k], dr * c[k])
                dc[k] = np.einsum("ij,ij->j", dr, e[x[:, k]])
            for p, s, g in zip(self.params, self.squares, (de, dc, dq, db)):
                g /= len(at)
                s += g * g
                p += rate * g / np.sqrt(s)

    def log10_table(self, ctx: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of all symbols but the pad after each context."""
        s = self.predicted(ctx) @ self.params[2][1:].T + self.params[3][1:]
        s -= s.max(axis=1, keepdims=True)
        return (s - np.log(np.exp(s).sum(axis=1, keepdims=True))) / np.float32(np.log(10))

    def log10_tokens(self, symbols: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        """Log10 probability of each token's symbol; every distinct context of the batch is multiplied out once."""
        base = len(self.noise) + 1
        key = ctx[:, 0] + base * (ctx[:, 1] + base * ctx[:, 2])
        order = np.argsort(key, kind="stable")
        new = np.append(True, key[order][1:] != key[order][:-1])
        group = np.cumsum(new) - 1
        first, out = order[new], np.empty(len(symbols))
        starts = np.append(np.flatnonzero(new), len(order))
        for a in range(0, len(first), 16384):
            z = min(a + 16384, len(first))
            lines = slice(starts[a], starts[z])
            out[order[lines]] = self.log10_table(ctx[first[a:z]])[group[lines] - a, symbols[order[lines]] - 1]
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _add(into: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """into[rows] += values, with repeated rows."""
    for k in range(values.shape[1]):
        into[:, k] += np.bincount(rows, values[:, k], len(into)).astype(np.float32)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over all texts, with the end of each text as a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = words_of(batch.column("text"))
            counts = np.bincount(words.codes, minlength=len(words.vocab))
            vocab = pa.concat_arrays([words.vocab, pa.array([END], words.vocab.type)])
            yield pa.RecordBatch.from_arrays([vocab, pa.array(np.append(counts, batch.num_rows))], names=["word", "c"])

    return docs.select("text").mapInArrow(run, "word string, c long").filter("c > 0").groupBy("word").agg(F.sum("c").alias("c"))


def lexicon_of(counts: DataFrame) -> Lexicon:
    # counts fall into steps of an eighth of a power of two; whole steps are taken from the top while they fit
    step = F.floor(F.log2(F.col("c").cast("double")) * 8).cast("int")
    sizes, taken, lowest = counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), 0, 1 << 30
    for r in sorted(sizes, key=lambda r: -r.step):
        if taken + r.n > HEAD:
            break
        taken, lowest = taken + r.n, r.step
    top = counts.filter(step >= lowest).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    head, head_counts = top.column("word").combine_chunks(), np.asarray(top.column("c").combine_chunks(), dtype=np.int64)
    listed = [w for w in head.slice(0, WORDS).to_pylist() if w != END]
    words = [END, *listed[: WORDS - 1]]
    accent = F.regexp_extract("word", r"[^\x00-\x7F]", 0)
    rest = counts.filter(~F.col("word").isin(words)).select(F.when(accent != "", accent).otherwise(F.right("word", F.lit(1))).alias("letter"), "c")
    by_letter = rest.groupBy("letter").agg(F.sum("c").alias("c"), F.count("*").alias("n"))
    best = by_letter.orderBy(F.desc("c"), "letter").limit(CLASSES - 1).collect()
    whole = by_letter.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    known = dict(zip(head.slice(0, WORDS + 1).to_pylist(), head_counts[: WORDS + 1].tolist()))
    ends = known.get(END) or next((r.c for r in counts.filter(F.col("word") == END).collect()), 0)
    sums = [ends, *(known[w] for w in words[1:]), *(r.c for r in best), whole.c - sum(r.c for r in best)]
    kinds = [1] * len(words) + [r.n for r in best] + [whole.n - sum(r.n for r in best)]
    return Lexicon(words, [r.letter for r in best], np.array(sums, dtype=np.float64), np.array(kinds, dtype=np.float64), head, head_counts)


def train(docs: DataFrame, lexicon: Lexicon) -> LogBilinear:
    """Fit on all of `docs(doc_id, text)`."""
    spark = docs.sparkSession
    model, rng = LogBilinear(lexicon.counts), np.random.default_rng(5)
    start = sorted(r.text for r in docs.filter(in_share(["text"], F.lit(SAMPLE), F.lit(max(1, docs.count())))).select("text").distinct().collect())
    if start:
        symbols, offsets, *_ = stream(lexicon, pa.array(start))
        ctx = contexts(symbols, offsets)
        for _ in range(EPOCHS):
            model.train(symbols, ctx, STEP, RATE, rng)
    shared, shapes = spark.sparkContext.broadcast((model, lexicon)), [p.shape for p in model.params]

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (own, known), tokens, draw = shared.value, 0, np.random.default_rng(9)
        own = LogBilinear.__new__(LogBilinear)
        own.noise, own.params, own.squares = shared.value[0].noise, [p.copy() for p in shared.value[0].params], [s.copy() for s in shared.value[0].squares]
        for batch in batches:
            symbols, offsets, *_ = stream(known, batch.column("text"))
            own.train(symbols, contexts(symbols, offsets), LATER_STEP, LATER_RATE, draw)
            tokens += len(symbols)
        if tokens:
            flat = np.concatenate([p.ravel() for p in own.params]).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat * tokens), pa.array(np.full(len(flat), tokens))], names=["i", "value", "tokens"])

    merged = docs.select("text").mapInArrow(steps, "i int, value double, tokens long").groupBy("i").agg((F.sum("value") / F.sum("tokens")).alias("value"))
    got = merged.toArrow().sort_by("i")  # as many rows as the model has parameters
    if got.num_rows:
        flat, at = np.asarray(got.column("value").combine_chunks(), dtype=np.float32), 0
        for k, shape in enumerate(shapes):
            model.params[k] = flat[at : at + int(np.prod(shape))].reshape(shape)
            at += int(np.prod(shape))
    return model


def score_documents(docs: DataFrame, held_fold: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document; documents of `held_fold` are only
    scored, the others are what is learned from."""
    spark = bounded_batches(docs.sparkSession)
    docs = with_text(docs).withColumn("held_out", F.coalesce(fold(F.col("doc_id")) == held_fold, F.lit(False)))
    learn = docs.filter("not held_out")
    counts = materialize(count_words(learn), "word-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    lexicon = lexicon_of(counts)
    shared = spark.sparkContext.broadcast((train(learn, lexicon), lexicon))
    n_words = len(lexicon.words)
    divisor = np.log10(lexicon.counts + 0.5 * (lexicon.kinds + 1))
    divisor[:n_words] = 0.0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value
        for batch in batches:
            n = batch.num_rows
            symbols, offsets, codes, vocab = stream(known, batch.column("text"))
            place = pc.index_in(vocab, value_set=known.head.cast(vocab.type))
            where = np.append(np.asarray(pc.fill_null(place, -1), dtype=np.int64), -2)[codes]  # of a token in the head
            end = codes == -1
            c = np.where(where >= 0, np.append(known.head_counts, 0)[where], 0).astype(np.float64)
            c[end] = known.counts[0]
            listed = (where >= 0) | end
            log_c = np.where(listed, np.log10(c + 0.5), 0.0)
            in_class = symbols > n_words
            model_part = model.log10_tokens(symbols, contexts(symbols, offsets)) - divisor[symbols - 1] + np.where(in_class, log_c, 0.0)
            rare = ~listed
            owner = np.repeat(np.arange(n), np.diff(offsets))[rare]
            pair, times = np.unique(owner * len(vocab) + codes[rare], return_counts=True) if rare.any() else (np.zeros(0, np.int64),) * 2
            rare_offsets = np.searchsorted(pair // max(1, len(vocab)), np.arange(n + 1))
            lists = pa.array(rare_offsets, pa.int32())
            words = pa.ListArray.from_arrays(lists, vocab.take(pa.array(pair % max(1, len(vocab)))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(offsets)), pa.array(sums_by((listed & (c > 0)).astype(float), offsets).astype(np.int64)),
                 pa.array(sums_by(log_c, offsets)), pa.array(sums_by(model_part, offsets)), words, pa.ListArray.from_arrays(lists, pa.array(times.astype(np.int32)))],
                names=["doc_id", "held_out", "n_tokens", "n_head", "base_head", "model_head", "rare", "times"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_head long, base_head double, model_head double, rare array<string>, times array<int>"
    scored = materialize(docs.mapInArrow(score, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    counted = rare.join(counts, "word", "left").select("row", "times", F.coalesce("c", F.lit(0)).alias("c"))
    by_row = counted.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 0.5)).alias("log_c"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("seen"))
    whole = float(np.log10(max(total.n + 0.5 * (total.v + 1), 0.5)))
    tail = F.coalesce("log_c", F.lit(0.0))
    return scored.drop("rare", "times").join(by_row, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(total.n).cast("long").alias("train_tokens"),
        (F.col("base_head") + tail - F.col("n_tokens") * whole).alias("base_score"), (F.col("model_head") + tail).alias("score"))


@query("op4_neural_lm")
def op4_neural_lm(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
