"""Vector codes: the tree against measuring every entry, the whole against plain rounds, odd rows."""

from __future__ import annotations

import math

import numpy as np
import pytest

from storyloom.llm import vector_codes as codes


@pytest.mark.parametrize("n,width,spread", [(64, 4, 60), (64, 4, 3), (64, 1, 5), (200, 4, 1000), (1, 4, 9), (8, 2, 9), (64, 4, 1 << 24), (64, 3, 1)])
def test_the_tree_finds_the_lowest_of_the_nearest(n, width, spread):
    rng = np.random.default_rng(n + width + spread)
    book = rng.integers(-spread, spread + 1, (n, width))
    book[n // 2 :: 5] = book[0]  # equal entries
    asked = np.concatenate([rng.integers(-spread, spread + 1, (3000, width)), book])
    entry, best, measured = codes.Search(book)(asked)
    every = codes.squares(asked, book)
    assert (best == every.min(axis=1)).all() and (entry == every.argmin(axis=1)).all()
    if (n, width) == (200, 4):
        assert measured < 0.8 * every.size  # whole subtrees were left out


def test_structured_queries_measure_few_entries():
    rng = np.random.default_rng(4)
    book = (rng.integers(0, 8, (512, 1)) * 10000 + rng.integers(0, 300, (512, 6))).astype(np.int64)
    asked = book[rng.integers(0, 512, 2000)] + rng.integers(-3, 4, (2000, 6))
    entry, best, measured = codes.Search(book)(asked)
    assert (entry == codes.squares(asked, book).argmin(axis=1)).all() and measured < 0.3 * 2000 * 512
    assert codes.Search(book)(asked[:0])[2] == 0


def plain(rows, parts, entries, rounds, scale):
    """(vec_id, label, code, error) by measuring every entry, in Python's integers."""
    kept = [(i, lab, [math.floor(x * scale) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * w : p * w + w]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, y)), k) for k, y in enumerate(book))
    books = [[cut(r[2], p) for r in kept[:entries]] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, _, v in kept:
                groups.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(c) for c in zip(*groups[k])] if k in groups else b for k, b in enumerate(books[p])]
    out = []
    for i, lab, v in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, lab, bytes(k for _, k in found), sum(d for d, _ in found)))
    return out, books


def test_codes_and_books_equal_plain_rounds(spark):
    rng = np.random.default_rng(6)
    values = np.round(rng.normal(size=(150, 8)), 2)
    rows = [(int(i) * 3 % 151, int(i) % 3 if i % 7 else None, [float(x) for x in v]) for i, v in enumerate(values)]
    rows += [rows[0], rows[5], (None, 1, rows[9][2]), (500, 2, [0.0] * 8), (501, 2, None), (502, None, [1.0] * 7 + [float("nan")]),
             (503, 0, [float("inf")] * 8), (504, 0, [1.0, None] * 4)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, vec array<float>, error int, code string").repartition(4)
    single = [(i, lab, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, lab, v in rows]
    for parts, entries, rounds in ((4, 16, 2), (2, 64, 1), (8, 300, 2)):
        want, books = plain(single, parts, min(entries, 256), rounds, 256)
        got, found = codes.compressed(df, parts, min(entries, 256), rounds)
        got = got.collect()
        assert found.tolist() == books
        key = lambda r: (r[0] is None, r[0] or 0, str(r[1]), r[2], r[3])
        assert sorted(((r.vec_id, r.label, bytes(r.code), r.error) for r in got), key=key) == sorted(want, key=key)
        sums = {}
        for _, lab, _, e in want:
            sums[lab] = sums.get(lab, 0) + e
        assert all(r.label_error == sums[r.label] for r in got)


def test_sizes_and_empty_tables(spark):
    rows = [(5, 1, [1.0] * 4), (6, 1, [2.0] * 4), (4, 1, [1.0] * 3), (7, None, [1.0] * 8), (8, 0, []), (9, 0, [1e9] * 4)]
    got, books = codes.compressed(spark.createDataFrame(rows, "vec_id long, label int, vec array<float>"), 2, 4, 2)
    assert sorted(r.vec_id for r in got.collect()) == [5, 6] and books.shape == (2, 2, 2)
    got, books = codes.compressed(spark.createDataFrame([], "vec_id long, label int, vec array<float>"))
    assert got.count() == 0 and len(codes.digest(books)) == 64
