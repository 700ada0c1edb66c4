"""Near duplicates of texts and vectors, and leaks, against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from storyloom.llm import decontaminate, embeddings, simhash


def components(n: int, links) -> list[int]:
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    return [root(x) for x in range(n)]


def fingerprint(text: str | None, size: int) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    parts = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_fingerprints_are_those_of_the_definition():
    texts = ["", "  ", "one", "One two", "\ta b\nc  d e ", "É É É é", "word " * 700, None, " ".join(str(i) for i in range(600))]
    got = simhash.fold_bits(*simhash.shingle_hashes(pa.array(texts), 4))
    assert got.tolist() == [fingerprint(t, 4) for t in texts]


def test_trie_join_finds_what_brute_force_finds():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, int(rng.integers(0, 7)), replace=False))) for b in base for _ in range(12)]
    values = np.unique(np.array(near, dtype=np.uint64))
    for budget in (0, 2, 4):
        i, j = simhash.trie_links(values, None, budget)
        want = {(a, b) for a in range(len(values)) for b in range(a + 1, len(values)) if int(values[a] ^ values[b]).bit_count() <= budget}
        assert set(zip(i.tolist(), j.tolist())) == want
    left, right = np.sort(values[::2]), np.sort(values[1::2])
    i, j = simhash.trie_links(left, right, 4)
    assert len(i) == sum(int(a ^ b).bit_count() <= 4 for a in left for b in right)


def test_links_across_blocks_are_complete(spark):
    """Small blocks force the dealing of a hot group into pairs of blocks."""
    rng = np.random.default_rng(3)
    values = sorted({int(v) for b in rng.integers(0, 1 << 62, 6) for v in [b ^ sum(1 << int(k) for k in rng.choice(62, int(rng.integers(0, 4)), replace=False)) for _ in range(60)]})
    prints = spark.createDataFrame([(v, v) for v in values], "id long, fp long")
    links = [(values.index(r.u), values.index(r.v)) for r in simhash.hamming_links(prints, [("fp", 0)], 4, len(values), block=16).collect()]
    want = [(a, b) for a in range(len(values)) for b in range(a + 1, len(values)) if (values[a] ^ values[b]).bit_count() <= 4]
    assert components(len(values), links) == components(len(values), want)


def test_near_duplicates_with_odd_rows(spark, odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs, size=4).collect()
    assert len(rows) == odd_docs.count()
    of = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert of[1] == 0 and of[2] == of[3] == of[4] and simhash.near_duplicates(no_docs).count() == 0


def test_near_copies_by_similarity(spark, no_docs):
    random.seed(2)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(6))
    rows, n = [], 0
    for _ in range(40):
        words = [word() for _ in range(200)]
        copy = list(words)
        for k in (20, 100, 150):  # three edits of 196 shingles: a similarity of about 0.86
            copy[k] = word()
        rows += [(n, " ".join(words)), (n + 1, " ".join(copy))]
        n += 2
    found = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(found[i] == i - 1 for i in range(1, n, 2)) >= 38 and all(found[i] == i for i in range(0, n, 2))
    assert simhash.near_copies(no_docs).count() == 0


def test_near_copies_are_those_of_the_similarity(spark):
    """Texts of any length, below, at and above 0.8, one contained in another, and chains: components of brute force."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    texts = []
    for n in (5, 6, 8, 10, 14, 30, 60, 70, 90, 200, 400):
        for part in (0.5, 0.6, 0.67, 0.7, 0.75, 0.79, 0.8, 0.82, 0.9):
            for _ in range(3):
                words = [word() for _ in range(n + 4)]
                texts.append(words)
                texts.append(words[: round(n * part) + 4])  # contained: the similarity is the part
                same = round(2 * n * part / (1 + part))
                texts.append(words[: same + 4] + [word() for _ in range(n - same)])
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    alike = [(a, b) for a in range(len(texts)) for b in range(max(0, a - 2), a) if len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b])]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert [found[i] for i in range(len(texts))] == components(len(texts), alike)


def texts_of_a_group(seed: int, n: int, share: float) -> list[str]:
    """Texts that have about a share of their shingles in common, all pairs alike."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    base = [word() for _ in range(100)]
    return [" ".join(base[: round(100 * share)] + [word() for _ in range(100 - round(100 * share))]) for _ in range(n)]


def jaccard_links(texts: list[str]) -> list[tuple[int, int]]:
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    return [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b])]


def test_alike_is_brute_force():
    rng = np.random.default_rng(1)
    for spread in (30, 60, 400):
        rows = [np.unique(rng.integers(0, spread, rng.integers(1, 40))) for _ in range(120)] + [np.arange(20), np.arange(21), np.zeros(0, np.int64)]
        bounds = np.append(0, np.cumsum([len(r) for r in rows]))
        links = simhash.alike(bounds, np.concatenate(rows).astype(np.int64), 0.5)
        want = [(a, b) for a in range(len(rows)) for b in range(a) if len(rows[a]) + len(rows[b]) and 2 * len(set(rows[a]) & set(rows[b])) >= len(set(rows[a]) | set(rows[b]))]
        assert components(len(rows), links) == components(len(rows), want) and len(links) < len(rows)


def test_what_verification_returns_grows_with_the_texts(spark, monkeypatch):
    """A large group of texts below the similarity, one above it, and blocks so small that both are cut."""
    texts = texts_of_a_group(1, 150, 0.85) + texts_of_a_group(2, 150, 0.93) + texts_of_a_group(3, 40, 0.5)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = components(len(texts), jaccard_links(texts))
    for verified in (1 << 20, 3000):
        monkeypatch.setattr(simhash, "VERIFIED", verified)
        found = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
        assert [found[i] for i in range(len(texts))] == want
    ids = docs.selectExpr("doc_id as id", "0L as component", "xxhash64(text) as text_key", "96L as n")
    links = simhash.similar_links(ids, docs.selectExpr("xxhash64(text) as text_key", "text"), 5, 0.8)
    assert links.count() <= 150 * 12  # a forest for each pair of blocks


def test_planted_pairs_at_the_similarity_are_found(spark):
    """600 pairs of Jaccard similarity 0.80 to 0.81, long and short: the share that is found."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    rows = []
    for k in range(600):
        n = rng.choice([9, 20, 45, 63, 64, 65, 90, 200, 400])
        same = -(-8 * n // 9)
        words = [word() for _ in range(n + 4)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: same + 4] + [word() for _ in range(n - same)]))]
    found = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    recall = sum(found[2 * k + 1] == 2 * k for k in range(600)) / 600
    print(f"recall at 0.8: {recall:.3f}")
    assert recall >= 0.99


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((30, 64))
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([base, base + 0.2 * rng.standard_normal(base.shape), base[:10] + 0.05 * rng.standard_normal((10, 64)), base[:5]]))]
    n = len(rows)
    rows += [(n, None), (n + 1, [0.0] * 64), (n + 2, [float("nan")] * 64), (n + 3, [1.0, None]), (n + 4, [1.0, 2.0]), (n + 5, [float("inf")] * 64), (n + 6, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.array([v for _, v in rows[:n]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.95) & ~np.eye(n, dtype=bool)
    comp = components(n, zip(*np.nonzero(near)))
    for block in (16, 2048):
        got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(df, block=block).collect()}
        assert [got[i] for i in range(n)] == [(int(near[i].sum()), comp[i]) for i in range(n)]
        assert all(got[i] == (0, i) for i in range(n, n + 7))
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.integers(0, 4, 9), rng.integers(-1, 4, 14)
        h = np.zeros((10, 15))
        for i in range(1, 10):
            for j in range(1, 15):
                h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontaminate.align(a[None], b[None])[0][0] == h.max()


def test_leaks_whole_edited_and_none(spark, odd_docs, no_docs):
    random.seed(4)
    word = lambda: random.choice("the of and to in a is that for it".split()) if random.random() < 0.4 else "".join(random.choice("abcdefgh") for _ in range(5))
    passages = [[word() for _ in range(40)] for _ in range(20)]
    items = spark.createDataFrame([(k, " ".join(p).capitalize() + ".") for k, p in enumerate(passages)] + [(50, None), (51, ""), (52, "two words"), (None, "lost in here")], "item_id long, text string")
    rows, want = [], set()
    for k in range(300):
        body = [word() for _ in range(200)]
        if k < 60:
            copy = list(passages[k % 20])
            for at in range(k % 3, 40, 9):  # none, then every ninth word edited or left out
                copy[at] = "edited" if k % 2 else ""
            body[80:80] = passages[k % 20] if k < 20 else copy
            want.add((k, k % 20))
        rows.append((k, " ".join(body)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()} == want
    assert decontaminate.find_leaks(odd_docs, items).count() == 0 == decontaminate.find_leaks(no_docs, items).count()
    assert decontaminate.find_leaks(docs, items.limit(0)).count() == 0
    unnamed = items.selectExpr("cast(null as long) as item_id", "text")
    found = decontaminate.find_leaks(docs, unnamed.unionByName(items.select("item_id", "text")))
    assert {r.doc_id for r in found.filter("item_id is null").collect()} == {d for d, _ in want}
    assert {(r.doc_id, r.item_id) for r in found.filter("item_id is not null").collect()} == want
    assert decontaminate.without_leaks(docs, unnamed).count() == docs.count() - len({d for d, _ in want})
