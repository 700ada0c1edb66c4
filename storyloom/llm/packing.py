"""Packing token sequences by minimum bin slack.

Every document becomes the ids of its whole text and an end id. Whole windows are cut off the front and are sequences of their
own; what remains is shorter than a window, and is cut again at half a window, since pieces of more than half a window leave gaps
that nothing may fit. Only the number of remainders of each length is needed to plan: the table of counts
has at most `window - 1` entries, however many documents there are. For the longest length that is left, a subset-sum dynamic
program over reachable totals, held as the bits of one integer and bounded by the counts, finds the multiset of lengths that
fills the rest of the window closest to capacity; the multiset is read back from the bit sets and used as often as the counts
allow, so the plan has a few patterns for each length and grows with the window, not with the data.

A remainder is given its place by its rank among those of its length: counts by partition of the written table give each
partition's first rank, and rows are numbered inside their partition, so no length is ever gathered in one task. Defined
results: null and empty texts are the end id alone; repeated rows and repeated ids are packed each; null ids are kept; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import bounded_batches, table, with_text
from storyloom.llm.registry import query
from storyloom.session import materialize

WINDOW, END_ID = 1024, 0
KEPT_PIECES = 400_000  # distinct blank-separated pieces whose ids a worker remembers before it begins anew
PIECES = "doc_id long, start long, length long, doc_tokens long, payload {}, part int, nth long"


class Encoder:
    """Ids of whole texts under a byte-level vocabulary file in the format of `tokenizers`.

    A text is cut before its blanks, where the vocabulary's word pattern always begins anew unless two blanks follow each other,
    and each distinct piece is encoded once. Texts with two blanks in a row or with a special token's string are encoded whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.known: dict[str, np.ndarray] = {}
        self.ranks = self._ranks(path)

    @staticmethod
    def _ranks(path: str):
        """The same merges as a tiktoken encoding, where they can be read as one: ids are equal, and it is several times faster."""
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            return None
        if spec["pre_tokenizer"].get("add_prefix_space"):
            return None
        # byte-level vocabularies write bytes as printable characters: printable ones as themselves, the others from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        added = {t["content"] for t in spec["added_tokens"]}
        vocab = {bytes(letters[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in added}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("pack", pat_str=pattern, mergeable_ranks=vocab, special_tokens={})

    def piece(self, text: str) -> np.ndarray:
        ids = self.ranks.encode_ordinary(text) if self.ranks else self.whole.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype=np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts of a batch, without end ids."""
        marked = np.zeros(len(texts), dtype=bool)
        for token in self.special:
            marked |= np.asarray(pc.match_substring(texts, token), dtype=bool)
        odd = marked | np.asarray(pc.match_substring(texts, "  "), dtype=bool)
        parts = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        offsets = np.asarray(parts.offsets, dtype=np.int64)
        flat = parts.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
        lead = np.ones(len(flat), dtype=bool)
        lead[offsets[:-1]] = False  # the first piece of a text has no blank before it
        flat = pc.binary_join_element_wise(pc.if_else(pa.array(lead), " ", ""), flat, "")
        coded = flat.dictionary_encode()
        if len(self.known) > KEPT_PIECES:
            self.known.clear()
        known, new = self.known, self.piece
        vocab = [known[w] if w in known else known.setdefault(w, new(w)) for w in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, vocab), np.int64, len(vocab))
        begin = np.cumsum(sizes) - sizes
        pool = np.concatenate([*vocab, np.zeros(0, np.uint32)]).astype(np.uint32)
        codes = np.asarray(coded.indices, dtype=np.int64)
        n = sizes[codes]
        ends = np.cumsum(n)
        ids = pool[np.repeat(begin[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[offsets]
        if not odd.any():
            return ids, bounds
        rows = [ids[a:b] for a, b in zip(bounds, bounds[1:])]
        for i in np.flatnonzero(odd):
            text = texts[int(i)].as_py()
            rows[i] = np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32) if marked[i] else self.piece(text)
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


def cut(docs: DataFrame, path: str, window: int, payload: str) -> DataFrame:
    """Pieces of at most `window` ids: (doc_id, start, length, doc_tokens, payload, part, nth), nth numbering the rows of a part."""
    kind = "array<int>" if payload == "ids" else "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, nth = Encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, bounds = encoder.encode(batch.column("text"))
            n = np.diff(bounds) + 1  # with the end id
            ids = np.insert(ids, bounds[1:], END_ID)
            base = np.cumsum(n) - n
            full, rest, half = n // window, n % window, window // 2
            pieces = full + (rest > 0) + (rest > half)
            doc = np.repeat(np.arange(len(n)), pieces)
            k = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = np.minimum(k, full[doc]) * window + np.where(k > full[doc], half, 0)
            length = np.where(k < full[doc], window, np.where(k == full[doc], np.where(rest[doc] > half, half, rest[doc]), rest[doc] - half))
            at = base[doc] + start
            if payload == "ids":
                carried = pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids.astype(np.int32)))
            else:
                raw = memoryview(ids.astype("<u4").tobytes())
                carried = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(n[doc]), carried,
                 pa.array(np.full(len(doc), part, dtype=np.int32)), pa.array(nth + np.arange(len(doc)))],
                names=["doc_id", "start", "length", "doc_tokens", "payload", "part", "nth"])
            nth += len(doc)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES.format(kind))


class Pattern(NamedTuple):
    """`times` sequences that hold `uses[length]` pieces of each length."""

    times: int
    uses: tuple[tuple[int, int], ...]


def fill(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The multiset of lengths, bounded by `counts`, whose sum is the largest that fits `room`: bit s of the set is on if the total s
    can be reached. The sets after each length are kept, and the multiset is read back from the last to the first."""
    mask, reach = (1 << (room + 1)) - 1, 1
    layers: list[tuple[int, int, int]] = []
    for length in sorted((x for x, c in counts.items() if c and x <= room), reverse=True):
        before, left, unit = reach, min(counts[length], room // length), 1
        while left:  # bounded copies by powers of two
            take = min(unit, left)
            reach |= reach << (take * length) & mask
            left, unit = left - take, unit * 2
        layers.append((length, before, min(counts[length], room // length)))
        if reach >> room & 1:
            break
    total, uses = reach.bit_length() - 1, []
    for length, before, most in reversed(layers):
        n = next(k for k in range(most + 1) if total >= k * length and before >> (total - k * length) & 1)
        if n:
            uses.append((length, n))
            total -= n * length
    return uses


def plan(counts: dict[int, int], window: int) -> list[Pattern]:
    """Patterns that place every remainder: the longest length left leads, the program fills the rest of its window."""
    counts, out = {k: v for k, v in counts.items() if v}, []
    while counts:
        lead = max(counts)
        rest = counts | {lead: counts[lead] - 1}
        uses = dict(fill(rest, window - lead))
        uses[lead] = uses.get(lead, 0) + 1
        times = min(counts[k] // n for k, n in uses.items())
        out.append(Pattern(times, tuple(sorted(uses.items(), reverse=True))))
        for k, n in uses.items():
            counts[k] -= times * n
            if not counts[k]:
                del counts[k]
    return out


def places(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, pieces of the length in a sequence, offset of the first of them)."""
    out, used, sequence = [], {}, 0
    for p in patterns:
        offset = 0
        for length, n in p.uses:
            first = used.get(length, 0)
            out.append((length, first, first + p.times * n, sequence, n, offset))
            used[length] = first + p.times * n
            offset += length * n
        sequence += p.times
    return out


def pack(docs: DataFrame, path: str, window: int = WINDOW, payload: str = "ids") -> DataFrame:
    """(doc_id, start, length, payload, doc_tokens, sequence_id, offset) of every piece of every document. `payload` is "ids", the
    piece's token ids, or "crc32", their checksum (little-endian unsigned 32-bit ids) for callers that need no ids."""
    spark = bounded_batches(docs.sparkSession)
    pieces = materialize(cut(with_text(docs), path, window, payload), "pieces")
    counts = materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    whole = totals.pop(window, 0)
    rows = [(window, 0, whole, 0, 1, 0)] + [(a, b, c, d + whole, e, f) for a, b, c, d, e, f in places(plan(totals, window))]
    lookup = spark.sparkContext.broadcast(_by_length(rows))

    # the first rank of each part and length: a running sum over the parts of a length
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranks = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("first_rank"))
    nth = F.row_number().over(Window.partitionBy("part", "length").orderBy("nth")) - 1
    ranked = pieces.withColumn("own", nth).join(ranks, ["part", "length"]).withColumn("rank", F.col("own") + F.col("first_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = lookup.value
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            for x in np.unique(length):
                own = np.flatnonzero(length == x)
                first, base, n, at = table_[int(x)]
                k = np.searchsorted(first, rank[own], side="right") - 1
                away = rank[own] - first[k]
                sequence[own], offset[own] = base[k] + away // n[k], at[k] + away % n[k] * x
            kept = [batch.column(c) for c in ("doc_id", "start", "length", "payload", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)],
                                             names=["doc_id", "start", "length", "payload", "doc_tokens", "sequence_id", "offset"])

    kind = dict(pieces.dtypes)["payload"]
    return ranked.select("doc_id", "start", "length", "payload", "doc_tokens", "rank").mapInArrow(
        place, f"doc_id long, start long, length long, payload {kind}, doc_tokens long, sequence_id long, offset long")


def _by_length(rows: list[tuple]) -> dict[int, tuple[np.ndarray, ...]]:
    out: dict[int, list] = {}
    for length, first, end, sequence, n, offset in rows:
        if end > first:
            out.setdefault(length, []).append((first, sequence, n, offset))
    return {k: tuple(np.array(sorted(v), dtype=np.int64).T) for k, v in out.items()}


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op3_packing")
def op3_packing(spark, sf_dir):
    out = pack(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary(), payload="crc32")
    return out.select("doc_id", "start", "length", F.col("payload").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
