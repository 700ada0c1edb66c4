"""Files of equal-length sequences: exact round trip against the plain tokenizer, views without copies, odd rows."""

from __future__ import annotations

import functools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from storyloom.llm import encoding, sequence_files as files
from storyloom.session import scratch_path

SAMPLE = ["", " ", "  two  blanks ", "\n \n x\t y ", "a<|endoftext|> b <|endoftext|>", "ünï çödé 漢字 🙂 don't", "x" * 5000, "1 2  3  4▁ 5", "\r\n", "tail  "]


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(files.byte_vocabulary())


def plain_ids(text):
    return tokenizer().encode(text, add_special_tokens=False).ids


def random_texts(n):
    rng = random.Random(5)
    parts = ["a", "the", " ", "  ", "\n", "\t", "don't", "<|endoftext|>", "9", "...", "é", "漢", " ", "▁", "word's", "\x00", "'ll"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_stretches_encode_like_whole_texts():
    texts = SAMPLE + random_texts(400)
    encode = encoding.TextIds(files.byte_vocabulary())
    assert encode.tokenizer.cuts
    whole = pa.array([None, *texts])[1:]  # an array with an offset
    for _ in range(2):  # the second time from memory
        ids, bounds = encode(whole)
        for k, t in enumerate(texts):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == plain_ids(t), t


def test_a_tokenizer_that_may_cross_blanks_gets_whole_texts():
    import json

    with open(files.byte_vocabulary(), encoding="utf-8") as f:
        spec = json.load(f)
    cuts = encoding.ByteLevel._cuts
    assert cuts(spec, False)
    assert not cuts(spec | {"normalizer": {"type": "NFC"}}, False)
    assert not cuts(spec | {"pre_tokenizer": {"type": "Whitespace"}}, False)
    assert not cuts(spec | {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}, False)
    assert encoding.stretches(pa.array(["a b", ""]), cut=False).vocab == ["a b"]


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(encoding, "KEPT", 2)
    monkeypatch.setattr(encoding, "CHUNK", 8)
    encode = encoding.TextIds(files.byte_vocabulary())
    for texts in ([" a b c d"], ["e  f", "a"], [" b", " b c "], ["x" * 50, ""]):
        ids, bounds = encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [plain_ids(t) for t in texts]
        assert len(encode.memory.number) <= 5


@pytest.mark.parametrize("length,rows", [(16, 4), (1024, 64), (1, 1)])
def test_files_read_back_what_was_written(spark, odd_docs, length, rows):
    listed = files.write_sequences(odd_docs, files.byte_vocabulary(), scratch_path(spark, "test"), length, rows)
    got = [tuple(r) for r in files.read_documents(listed).collect()]
    want, start = [], 0
    docs = odd_docs.selectExpr("doc_id", "coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as tie").collect()
    for r in sorted(docs, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.tie)):
        ids = plain_ids(r.text) + [files.END_ID]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


@pytest.mark.parametrize("largest,kind", [(255, np.uint8), (50256, np.uint16), (2**32 - 1, np.uint32)])
def test_sequences_are_views_of_the_mapped_file(tmp_path, largest, kind):
    path = str(tmp_path / "x" / "part.arrow")
    out, rng = files.Writer(path, 8, 4, largest), np.random.default_rng(1)
    all_ids, doc = [], 0
    for n in (0, 3, 100, 1, 31):
        ids = rng.integers(0, largest + 1, n)
        out.add([doc], ids, np.array([0, n]))
        all_ids, doc = [*all_ids, *ids.tolist()], doc + 1
    out.close()
    seq = files.Sequences(path)
    assert len(seq) == -(-len(all_ids) // 8) and seq.local
    for i in [len(seq) - 1, 0, *range(len(seq))]:
        ids, mask = seq[i]
        real = sum(mask.to_pylist())
        assert ids.dtype == kind and ids.tolist()[:real] == all_ids[8 * i : 8 * i + 8] and len(ids) == len(mask) == 8
        assert mask.to_pylist() == [True] * real + [False] * (8 - real)
    before = pa.total_allocated_bytes()
    views = [seq[i] for i in range(len(seq))]
    assert pa.total_allocated_bytes() == before and len(views) == len(seq)  # nothing was copied
    seq.source.seek(0)
    whole = range(low := seq.source.read_buffer(seq.source.size()).address, low + seq.source.size())
    for ids, mask in views:
        assert ids.ctypes.data in whole and mask.buffers()[1].address in whole and not ids.flags.owndata
    assert np.concatenate(list(seq.span(2, 130))).tolist() == all_ids[2:132]
    with pytest.raises(IndexError):
        seq[len(seq)]
    assert [d for b in files.documents_of(path) for d in b.column("n_tokens").to_pylist()] == [0, 3, 100, 1, 31]


def test_an_empty_table_gives_nothing(spark, no_docs):
    listed = files.write_sequences(no_docs, files.byte_vocabulary(), scratch_path(spark, "none"))
    assert listed.count() == 0 and files.read_documents(listed).count() == 0
