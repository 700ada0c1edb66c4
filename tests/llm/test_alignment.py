"""Alignment of two tokenizers against a plain two-pointer version that encodes whole texts."""

from __future__ import annotations

import functools
import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from storyloom.llm import alignment, encoding

A_PATH, B_PATH = alignment.vocabularies()


@functools.cache
def models():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    return a, b, letters


def tokens(text):
    """(ids and bytes of A, ids and bytes of B) of a whole text, or None."""
    a, b, letters = models()
    if not text:
        return None
    ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    ba = [bytes(letters[c] for c in a.id_to_token(i)) for i in ia]
    bb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ib for p in [b.id_to_piece(i)]]
    raw = (" " + text).encode()
    return (ia, ba, ib, bb) if b"".join(ba) == raw and b"".join(bb) == raw else None


def brute(docs):
    links, rows = [], []
    for doc_id, text in docs:
        t = tokens(text)
        own, shown, groups = [], "", 0
        if t:
            ia, ba, ib, bb = t
            ea, eb = np.cumsum([len(x) for x in ba]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
            for i, end in enumerate(ea):
                for j, other in enumerate(eb):
                    if max(end - len(ba[i]), other - len(bb[j])) < min(end, other):
                        own.append((ia[i], ib[j]))
            common = sorted(set(ea) & set(eb))
            groups, last, parts = len(common), 0, []
            for c in common:
                parts.append(",".join(str(x) for x, e in zip(ia, ea) if last < e <= c) + "|" + ",".join(str(x) for x, e in zip(ib, eb) if last < e <= c))
                last = c
            shown = hashlib.sha256(";".join(parts).encode()).hexdigest()
        links.append(own)
        rows.append([doc_id, len(t[0]) if t else 0, len(t[2]) if t else 0, groups, len(own), shown])
    count = Counter(x for own in links for x in own)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(*r, sum(count[x] for x in own), sum(count[x] == most[x[1]] for x in own)) for r, own in zip(rows, links)]


PARTS = ["a", "the", "unbelievable", " ", "  ", "\n", "\t", "don't", "<|endoftext|>", "</s>", "<0x41>", "97", "...", "é", "漢字", "🙂", "word's", "\x00", "'ll", "def f(x):"]
TEXTS = [None, "", " ", "   ", "▁", "a▁b", "\n", "one", "one", " lead", "tail ", "x" * 300, "word " * 200, "naïve 漢字 🙂 <s> \r\n text"]


def random_texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_gallop_is_a_lower_bound():
    rng = np.random.default_rng(2)
    for size, share in ((0, 1.0), (1, 1.0), (5000, 0.9), (5000, 0.01), (40000, 0.5)):
        longer = np.cumsum(rng.integers(1, 4, size + 1))
        driver = np.unique(rng.integers(1, longer[-1] + 1, int(share * size)))
        assert (alignment.gallop(driver, longer) == np.searchsorted(longer, driver)).all()


def test_stretches_encode_like_whole_texts_under_both():
    aligner = alignment.Aligner(A_PATH, B_PATH)
    assert aligner.cut
    for t in filter(None, TEXTS + random_texts(300)):
        s = encoding.stretches(pa.array([" " + t]))
        numbers = aligner.memory(s.vocab)[s.codes]
        want = tokens(t)
        assert aligner.memory.spelt[numbers].all() == (want is not None), t
        if want:
            assert [aligner.memory.strung(k, numbers)[0].tolist() for k in (0, 1)] == [want[0], want[2]], t


def test_bytes_that_do_not_spell_the_text_are_noticed():
    aligner = alignment.Aligner(A_PATH, B_PATH)
    aligner.cut = False  # whole texts give the same
    whole = aligner.batch(pa.array(["a b", "c▁d", ""]))
    assert whole.column("n_a").to_pylist() == [2, 0, 0] and whole.column("groups_sha256").to_pylist()[1:] == ["", ""]


@pytest.mark.parametrize("head", [alignment.HEAD, 40, 0])
def test_documents_agree_with_brute_force(spark, head):
    docs = list(enumerate(TEXTS + random_texts(120))) + [(None, "a row without an id"), (3, "again the same id"), (7, "one")]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n_a long, pairs string").repartition(3)
    got = alignment.cross_aligned(df, A_PATH, B_PATH, head)
    got = [tuple(r) for r in got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "count_sum", "n_best").collect()]
    assert sorted(got, key=repr) == sorted(brute(docs), key=repr)


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    assert alignment.cross_aligned(odd_docs, A_PATH, B_PATH).count() == odd_docs.count()
    assert alignment.cross_aligned(no_docs, A_PATH, B_PATH).count() == 0
