"""Token ids of whole texts, with each distinct stretch of text encoded once.

A text is cut before every run of blanks that follows another character, and between a letter and a mark, both of ASCII. The
tokenizers here never build a token across such a place, so the ids of a text are those of its stretches in order; what makes that
true is read from the tokenizer's file and checked, and a tokenizer that does not promise it gets whole texts. Cutting, numbering the
distinct stretches and joining their ids are numpy and Arrow work; the tokenizer's own library sees a stretch once per worker, many of
them strung together in one call, each at a place where a text would be cut.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEPT = 400_000  # distinct stretches whose ids a worker remembers before it begins anew
CHUNK = 1 << 16  # bytes of new stretches that the library encodes in one call
SLICE_BYTES = 4 << 20  # text that is worked on at a time; a longer text is a slice of its own


class Stretches(NamedTuple):
    """Text i consists of the stretches codes[offsets[i]:offsets[i + 1]], positions in `vocab`."""

    offsets: np.ndarray
    codes: np.ndarray
    vocab: list[str]


def slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of a bounded number of bytes at a time."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    at = 0
    for end in np.flatnonzero(np.diff(np.append(np.cumsum(sizes) // SLICE_BYTES, -1)) != 0) + 1:
        yield at, texts.slice(at, int(end) - at)
        at = int(end)


BLANK, LETTER, MARK = 1, 2, 3
KINDS = np.zeros(256, dtype=np.uint8)
KINDS[32] = BLANK
KINDS[[*range(65, 91), *range(97, 123)]] = LETTER
KINDS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = MARK
MARKS = frozenset(chr(k) for k in np.flatnonzero(KINDS == MARK))


def stretches(texts: pa.Array, cut: bool = True, whole: np.ndarray | None = None) -> Stretches:
    """The stretches of texts without nulls; without `cut`, and in the rows of `whole`, every text that is not empty is one stretch."""
    n = len(texts)
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int32)
    buffer = texts.buffers()[2] if n else None
    first, last = int(bounds[0]), int(bounds[-1])
    begins = np.zeros(last - first, dtype=bool)
    if cut and last > first:
        kind = KINDS[np.frombuffer(buffer, dtype=np.uint8)[first:last]]
        begins[1:] = ((kind[1:] == BLANK) & (kind[:-1] != BLANK)) | ((kind[1:] == MARK) & (kind[:-1] == LETTER))
        for i in np.flatnonzero(whole) if whole is not None else ():
            begins[bounds[i] - first : bounds[i + 1] - first] = False
    begins[(bounds[:-1] - first)[bounds[:-1] < bounds[1:]]] = True
    starts = (np.flatnonzero(begins) + first).astype(np.int32)
    offsets = np.searchsorted(starts, bounds)
    if not len(starts):
        return Stretches(offsets, np.zeros(0, np.int64), [])
    parts = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, np.int32(last))), buffer)
    coded = parts.dictionary_encode()
    return Stretches(offsets, np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist())


FILLER = " a"  # stands before a stretch that begins with a mark, or where a model wants a text's beginning


class Vocabulary:
    """What both kinds of tokenizer share: the bytes of every id, and the encoding of many stretches in few calls."""

    cuts: bool
    bytes: list[bytes]

    def ids(self, text: str) -> list[int]:
        raise NotImplementedError

    def alone(self, word: str) -> list[int]:
        return self.ids(word)

    def _sized(self) -> None:
        self.sizes = np.array([len(x) for x in self.bytes], dtype=np.int64)

    def many(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each word's ids begin, how many they are, whether they spell it). Words that can stand side by side are strung
        together, as they would be in a text, and the ids are dealt out by their bytes; what does not come out even is encoded by itself."""
        pool, held = [], 0
        begin, count, spelt = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        chunks, size, rest = [[]], 0, []
        for k, w in enumerate(words):
            if not self.cuts or w[-1] == " " or not (w[0] == " " or w[0] in MARKS):
                rest.append(k)
                continue
            chunks[-1].append(k)
            size += len(w)
            if size >= CHUNK:
                chunks, size = [*chunks, []], 0
        for chunk in filter(None, chunks):
            found = self._strung([words[k] for k in chunk])
            if found is None:
                rest += chunk
                continue
            pool.append(found[0])
            count[chunk] = found[1]
            begin[chunk] = held + np.cumsum(found[1]) - found[1]
            spelt[chunk] = True
            held += len(found[0])
        for k in rest:
            ids = self.alone(words[k])
            pool.append(np.array(ids, dtype=np.int32))
            begin[k], count[k], spelt[k] = held, len(ids), b"".join([self.bytes[i] for i in ids]) == words[k].encode()
            held += len(ids)
        return np.concatenate([*pool, np.zeros(0, np.int32)]), begin, count, spelt

    def _strung(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids of the words, ids per word), or None where the ids do not spell the words one after the other."""
        raw, own = [], []
        for w in words:
            if w[0] != " ":
                raw.append(FILLER.encode())
                own.append(False)
            raw.append(w.encode())
            own.append(True)
        text = b"".join(raw)
        ids = self.ids(text.decode())
        if b"".join([self.bytes[i] for i in ids]) != text:
            return None
        ids = np.array(ids, dtype=np.int32)
        ends, bounds = np.cumsum(self.sizes[ids]), np.cumsum([len(r) for r in raw])
        at = np.searchsorted(ends, bounds)
        if not (ends[at] == bounds).all():
            return None
        own, counts = np.array(own), np.diff(at, prepend=-1)
        return ids[np.repeat(own, counts)], counts[own]


class Memory:
    """The ids of stretches under some vocabularies. Stretches are numbered as they come; the ids of all numbers lie in one array per
    vocabulary. When too many are held, all are forgotten."""

    def __init__(self, *vocabularies: Vocabulary):
        self.vocabularies = vocabularies
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.pools = [[np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)] for _ in self.vocabularies]  # ids, begins, counts
        self.spelt = np.zeros(0, dtype=bool)  # whether all vocabularies spell the stretch

    def __call__(self, vocab: list[str]) -> np.ndarray:
        """The numbers of the stretches, good until the next call."""
        if len(self.number) > KEPT or sum(len(p[0]) for p in self.pools) > 8 * KEPT:
            self._forget()
        number = self.number
        new = [w for w in vocab if w not in number]
        if new:
            fine = np.ones(len(new), dtype=bool)
            for pool, v in zip(self.pools, self.vocabularies):
                ids, begin, count, spelt = v.many(new)
                fine &= spelt
                pool[:] = [np.concatenate(x) for x in ((pool[0], ids), (pool[1], begin + len(pool[0])), (pool[2], count))]
            self.spelt = np.concatenate([self.spelt, fine])
            number.update(zip(new, range(len(number), len(number) + len(new))))
        return np.fromiter(map(number.__getitem__, vocab), np.int64, len(vocab))

    def strung(self, k: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of the stretches one after the other under vocabulary k, and where each stretch's end."""
        pool, begin, count = self.pools[k]
        n = count[numbers]
        ends = np.cumsum(n)
        return pool[np.repeat(begin[numbers] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], ends


class ByteLevel(Vocabulary):
    """A byte-level BPE file of `tokenizers`. `plain` takes the strings of special tokens inside texts as ordinary text."""

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.cuts = self._cuts(spec, plain)
        # byte-level vocabularies write bytes as printable characters: printable ones as themselves, the others from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.bytes = [b""] * (1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]))
        for entry, i in spec["model"]["vocab"].items():
            self.bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        for t in spec["added_tokens"]:
            self.bytes[t["id"]] = t["content"].encode()
        self._sized()
        self.special = [] if plain else [t["content"] for t in spec["added_tokens"]]

    def marked(self, texts: pa.Array) -> np.ndarray:
        """The texts that hold a special token's string; they are not cut."""
        out = np.zeros(len(texts), dtype=bool)
        for token in self.special:
            out |= np.asarray(pc.match_substring(texts, token), dtype=bool)
        return out

    @staticmethod
    def _cuts(spec: dict, plain: bool) -> bool:
        before = spec.get("pre_tokenizer") or {}
        added = [] if plain else spec["added_tokens"]
        return (
            spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and not spec.get("normalizer")
            and not spec.get("truncation") and not spec.get("padding")
            and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        )

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class PieceModel(Vocabulary):
    """A sentencepiece model with byte fallback; `ids` takes texts that begin with the blank that the model adds by itself."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm, mark = spec.normalizer_spec, "▁"
        self.cuts = (
            norm.name == "identity" and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
            and not any(p.type == p.USER_DEFINED or mark in p.piece.lstrip(mark) for p in spec.pieces)
            and not any(self._crosses(p.piece) for p in spec.pieces if p.type == p.NORMAL)
        )
        self.bytes = [
            bytes([int(p.piece[3:5], 16)]) if p.type == p.BYTE else p.piece.replace(mark, " ").encode() for p in spec.pieces
        ]
        self._sized()
        self.filler = len(self.ids(FILLER))

    @staticmethod
    def _crosses(piece: str) -> bool:
        """Whether a mark follows a letter in a piece."""
        return any(a.isascii() and a.isalpha() and b in MARKS for a, b in zip(piece, piece[1:]))

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text[1:])

    def alone(self, word: str) -> list[int]:
        return self.ids(FILLER + word)[self.filler :] if self.cuts else self.ids(word)


class TextIds:
    """Ids of the texts of an Arrow array under a byte-level file."""

    def __init__(self, path: str):
        self.tokenizer = ByteLevel(path)
        self.memory = Memory(self.tokenizer)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): text i has ids[bounds[i]:bounds[i + 1]]."""
        s = stretches(texts, self.tokenizer.cuts, self.tokenizer.marked(texts))
        ids, ends = self.memory.strung(0, self.memory(s.vocab)[s.codes])
        return ids, np.append(0, ends)[s.offsets]


@functools.cache
def text_ids(path: str) -> TextIds:
    """One per Python worker, which serves many tasks."""
    return TextIds(path)
