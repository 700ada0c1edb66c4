"""SimHash near-duplicates: fingerprints of word shingles, linked by a binary trie joined with itself.

A fingerprint bit is set if it is set in over half of the XXH64 hashes of a text's shingles. Two fingerprints link if they
differ in at most `budget` bits. Equal fingerprints are collapsed first, so copies of a text cost one row. The bits are cut
into a few bands more than the budget; two linked fingerprints agree in all bands but `budget`, so for each choice of agreeing
bands a trie with their bits on top is grown, in which no error is allowed above and the whole budget below: pairs of trie
nodes are visited together from the root, the differing bits add up, and a pair is dropped once they exceed the budget. A trie
is dealt out by its top bits, as many as make subtrees of about half a block. A subtree of more than `BLOCK` fingerprints is
dealt into blocks and each pair of blocks becomes a task of its own, so a hot group is spread and nothing is left out. More
bands, as the table grows, keep subtrees small at any size; the links found are the same. A task returns the links of a
spanning forest of what it found, never all pairs; components settle in Spark.

Defined results: null and empty texts have fingerprint zero and link like any other; texts shorter than a shingle are one
shingle; repeated rows and repeated ids are each counted as documents of the same fingerprint; null ids never represent a
group unless all of its ids are null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import table, with_text, words_of
from storyloom.llm.registry import query
from storyloom.operators.dedup import connected_components, forest
from storyloom.session import materialize

BITS, SEED = 64, 42
BLOCK = 4096  # fingerprints of one block; a task joins two blocks at most
LEAF = 8  # a node pair with this many pairs of fingerprints or fewer is compared outright

# lane k of SPREAD[b] is bit k of the byte b: eight counters in one 64-bit word
SPREAD = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.uint64)
          << (8 * np.arange(8, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)


def shingle_hashes(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): XXH64 of every shingle of every text, in order; a shorter text is one shingle, one without words none."""
    words = words_of(texts)
    parts = pa.ListArray.from_arrays(pa.array(words.offsets, pa.int32()), words.vocab.take(pa.array(words.codes)))
    joined = pc.binary_join(parts, " ")
    if isinstance(joined, pa.ChunkedArray):
        joined = joined.combine_chunks()
    data = joined.buffers()[2].to_pybytes() if len(joined) and joined.buffers()[2] else b""
    base = np.frombuffer(joined.buffers()[1], dtype=np.int32)[joined.offset : joined.offset + len(joined) + 1].astype(np.int64)
    sizes = np.asarray(pc.binary_length(words.vocab), dtype=np.int64)[words.codes]
    counts = np.diff(words.offsets)
    # word k of text i starts where the words and single blanks before it end
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(sizes) else np.zeros(0, dtype=np.int64)
    first = np.where(counts > 0, words.offsets[:-1], 0)
    shift = base[:-1] - (begins[first] if len(begins) else 0)
    begins = begins + np.repeat(shift, counts)
    ends = begins + sizes
    n = np.where(counts == 0, 0, np.maximum(1, counts - size + 1))
    offsets = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(len(n)), n)
    start = np.arange(offsets[-1]) - offsets[owner] + words.offsets[owner]
    stop = np.minimum(start + size - 1, words.offsets[owner + 1] - 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(data[a:b], SEED) for a, b in zip(begins[start].tolist(), ends[stop].tolist())), np.uint64, len(start))
    return hashes, offsets


def hashed_slices(texts: pa.Array, size: int, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The hashes of a few texts at a time: what is held is bounded by the texts, not by the batch."""
    for a in range(0, len(texts), rows):
        yield shingle_hashes(texts.slice(a, rows), size)


def fold_bits(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A fingerprint per slice: bit k is set if it is set in over half of the slice's hashes. Bits are counted eight at a time in
    the lanes of a 64-bit word, over runs of at most 255 hashes."""
    n = len(offsets) - 1
    out = np.zeros(n, dtype=np.uint64)
    if not len(hashes):
        return out
    counts = np.diff(offsets)
    runs = -(-counts // 255)
    owner = np.repeat(np.arange(n), runs)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    starts = offsets[owner] + 255 * nth
    full = np.flatnonzero(counts > 0)
    firsts = (np.cumsum(runs) - runs)[full]
    by_byte = hashes.view(np.uint8).reshape(-1, 8)  # little-endian: byte k holds bits 8k to 8k+7
    for k in range(8):
        lanes = np.add.reduceat(SPREAD[by_byte[:, k]], starts).view(np.uint8).reshape(-1, 8)
        total = np.add.reduceat(lanes.astype(np.int64), firsts, axis=0)
        over = 2 * total > counts[full, None]
        out[full] |= (over.astype(np.uint64) << (np.uint64(8 * k) + np.arange(8, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, fp) of every document; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.concatenate([fold_bits(*part) for part in hashed_slices(batch.column("text"), size)] or [np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def choices(budget: int, count: int, block: int, bits: int = BITS) -> list[list[tuple[int, int]]]:
    """Orders of the bands, as (lowest bit, width), with the bands that must agree first: one order per choice of them. There is
    one band more than the budget, or as many more as make the agreeing bits enough to cut `count` into subtrees of a block."""
    for extra in range(1, 5):
        n = budget + extra
        edges = [round(k * bits / n) for k in range(n + 1)]
        parts = [(a, b - a) for a, b in zip(edges, edges[1:])]
        if count <= block << min(sum(w for _, w in c) for c in combinations(parts, extra)):
            break
    return [[*c, *(p for p in parts if p not in c)] for c in combinations(parts, extra)]


def _lead(order: list[tuple[int, int]], budget: int) -> list[tuple[int, int]]:
    return order[: len(order) - budget]


def reordered(fp: np.ndarray, order: list[tuple[int, int]], bits: int = BITS) -> np.ndarray:
    """The fingerprints with their bands in the given order, the first on top."""
    out, at = np.zeros(len(fp), dtype=np.uint64), bits
    for low, width in order:
        at -= width
        out |= ((fp >> np.uint64(low)) & np.uint64((1 << width) - 1)) << np.uint64(at)
    return out


def trie_links(left: np.ndarray, right: np.ndarray | None, budget: int, equal: int = 0, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of fingerprints that differ in at most `budget` bits, between two sorted arrays or within one; the
    first `equal` bits must agree.

    A node of the binary trie is a range of the sorted array with a common prefix. All node pairs of a level are held side by
    side: each has a range in either trie and its number of differing bits so far."""
    own = right is None
    right = left if own else right
    if not len(left) or not len(right):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    pairs = np.array([[0, len(left), 0, len(right), 0]], dtype=np.int64)
    found_i, found_j = [], []
    for depth in range(bits):
        area = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
        small = (area <= LEAF) & (depth >= equal)
        _compare(left, right, pairs[small], budget, found_i, found_j)
        pairs = pairs[~small]
        if not len(pairs):
            break
        bit = np.uint64(bits - 1 - depth)
        mid_l, mid_r = _middles(left, pairs[:, 0], pairs[:, 1], bit), _middles(right, pairs[:, 2], pairs[:, 3], bit)
        lo_l, hi_l = np.stack([pairs[:, 0], mid_l]), np.stack([mid_l, pairs[:, 1]])
        lo_r, hi_r = np.stack([pairs[:, 2], mid_r]), np.stack([mid_r, pairs[:, 3]])
        nxt = []
        for a in (0, 1):
            for b in (0, 1) if depth >= equal else (a,):
                p = np.stack([lo_l[a], hi_l[a], lo_r[b], hi_r[b], pairs[:, 4] + (a != b)], axis=1)
                ok = (p[:, 4] <= budget) & (p[:, 0] < p[:, 1]) & (p[:, 2] < p[:, 3])
                if own:
                    ok &= p[:, 0] <= p[:, 2]  # the mirrored pair is visited from the other side
                nxt.append(p[ok])
        pairs = np.concatenate(nxt)
    else:
        _compare(left, right, pairs, budget, found_i, found_j)
    i, j = np.concatenate(found_i or [np.zeros(0, np.int64)]), np.concatenate(found_j or [np.zeros(0, np.int64)])
    keep = i < j if own else np.ones(len(i), dtype=bool)
    return i[keep], j[keep]


def _middles(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Where the values of each range, which share the higher bits, begin to have the bit set."""
    ones = np.concatenate([[0], np.cumsum((values >> bit) & np.uint64(1)).astype(np.int64)])
    return hi - (ones[hi] - ones[lo])


def _compare(left: np.ndarray, right: np.ndarray, pairs: np.ndarray, budget: int, found_i: list, found_j: list) -> None:
    wide = pairs[:, 3] - pairs[:, 2]
    area = (pairs[:, 1] - pairs[:, 0]) * wide
    for a in range(0, len(pairs), 1 << 20):  # bounded memory, however many node pairs meet at a level
        n, w, p = area[a : a + (1 << 20)], wide[a : a + (1 << 20)], pairs[a : a + (1 << 20)]
        owner = np.repeat(np.arange(len(p)), n)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        i, j = p[owner, 0] + k // w[owner], p[owner, 2] + k % w[owner]
        near = np.bitwise_count(left[i] ^ right[j]) <= budget
        found_i.append(i[near])
        found_j.append(j[near])


def nearest_forest(a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of the given pairs, a spanning forest of them, the nearest first: every link is a pair that was met."""
    parent: dict[int, int] = {}
    keep = []
    order = np.argsort(apart, kind="stable")
    for k, x, y in zip(order.tolist(), a[order].tolist(), b[order].tolist()):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        while (up := parent.setdefault(y, y)) != y:
            parent[y] = parent[up]
            y = up
        if x != y:
            parent[x] = y
            keep.append(k)
    return a[keep], b[keep]


def _join_blocks(orders: list, budget: int, bits: int, checks: list[str], allowed: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        order, x, y = orders[key[1]], key[3], key[4]
        equal = sum(w for _, w in _lead(order, budget))
        moved = reordered(rows["fp"].to_numpy().view(np.uint64), order, bits)
        sort = np.argsort(moved)
        moved, ids, block = moved[sort], rows["id"].to_numpy()[sort], rows["block"].to_numpy()[sort]
        left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
        i, j = trie_links(moved[left], None if x == y else moved[right], budget, equal, bits)
        i, j = left[i], right[j]
        if not checks:
            return pd.DataFrame(forest(ids[i], ids[j]), columns=["u", "v"], dtype="int64")
        wide = [rows[c].to_numpy().view(np.uint64)[sort] for c in checks]
        differ = sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int64) for w in wide)
        near = differ <= allowed
        u, v = nearest_forest(ids[i[near]], ids[j[near]], differ[near])
        return pd.DataFrame({"u": np.minimum(u, v), "v": np.maximum(u, v)}, dtype="int64")

    return run


def _dealt(orders: list, columns: list[tuple[str, int]], budget: int, bits: int, wanted: int, extra: list[str]):
    """A row per fingerprint and choice of agreeing bands: (id, extra..., print, choice, top, fp), `top` being the highest `wanted` bits
    of its trie among those that must agree. `columns` names 64-bit columns and the lowest bit of the fingerprint in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, (column, low) in enumerate(columns):
                fp = np.asarray(b.column(column)).view(np.uint64) >> np.uint64(low)
                if bits < BITS:
                    fp = fp & np.uint64((1 << bits) - 1)
                for k, order in enumerate(orders):
                    width = min(wanted, sum(w for _, w in _lead(order, budget)))
                    top = reordered(fp, order, bits) >> np.uint64(bits - width) if width else np.zeros(len(fp), np.uint64)
                    same = [pa.array(np.full(len(fp), x, dtype=np.int32)) for x in (n, k)]
                    yield pa.RecordBatch.from_arrays(
                        [b.column("id"), *(b.column(c) for c in extra), *same, pa.array(top.view(np.int64)), pa.array(fp.view(np.int64))],
                        names=["id", *extra, "print", "choice", "top", "fp"])

    return run


def hamming_links(prints: DataFrame, columns: list[tuple[str, int]], budget: int, count: int, bits: int = BITS, checks: tuple = (), allowed: int = 0,
                  block: int = BLOCK) -> DataFrame:
    """(u, v): links between ids that connect all rows of `prints(id, ...)`, `count` of them, that differ in at most `budget` of `bits`
    bits in one of `columns` (a 64-bit column and the lowest bit of a fingerprint in it), and over all `checks` together in at most
    `allowed` bits. With `checks` a link is a pair that differs so."""
    orders = choices(budget, count, block, bits)
    wanted = max(0, (2 * count // block).bit_length())
    extra = list(checks)
    needed = [x for x in dict.fromkeys(c for c, _ in columns) if x not in extra]
    fields = "".join(f"{c} long, " for c in extra)
    keyed = prints.select("id", *extra, *needed).mapInArrow(
        _dealt(orders, columns, budget, bits, wanted, extra), f"id long, {fields}print int, choice int, top long, fp long")
    group = ["print", "choice", "top"]
    sizes = keyed.groupBy(*group).agg(F.ceil(F.count("*") / F.lit(block)).cast("long").alias("n"))
    mine = keyed.join(sizes, group).withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")))
    # a row of block b goes to every pair of blocks that b is in; a single block needs itself only
    pairs = mine.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select(
        *group, F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "id", "fp", "block", *extra)
    run = _join_blocks(orders, budget, bits, list(checks), allowed)
    return pairs.groupBy(*group, "x", "y").applyInPandas(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, budget: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): documents whose 64-bit fingerprints link; the smallest doc_id reachable, itself included."""
    prints = materialize(fingerprints(with_text(docs), size), "simhash")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    links = hamming_links(distinct.select(F.col("fp").alias("id"), "fp"), [("fp", 0)], budget, distinct.count())
    whole = distinct.join(connected_components(links).withColumnRenamed("id", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    smallest = whole.groupBy("component").agg(F.min("first").alias("component_id"))
    roots = whole.join(smallest, "component").select("fp", "component_id")
    return prints.join(roots, "fp").select("doc_id", "fp", "component_id")


def _distinct(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each slice: similarity is one of sets, so repeated lines weigh once."""
    parts = [np.unique(hashes[a:b]) for a, b in zip(offsets, offsets[1:])]
    return np.concatenate([*parts, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def _families(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A fingerprint per family and slice: each family mixes the hashes anew, by multiplying and shifting."""
    out = []
    for k in range(FAMILIES):
        x = hashes + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(fold_bits(x ^ (x >> np.uint64(31)), offsets))
    return np.stack(out)


FAMILIES, CHECKS = 8, 3  # 64-bit fingerprints of a text; those that a candidate link is judged by
HALF, HALF_BUDGET = 32, 4
SHORT = 64  # distinct shingles up to which texts meet by shingles; their bits say too little


def allowed_bits(similarity: float, bits: int) -> int:
    """How many of `bits` bits two sets of equal size with this Jaccard similarity may differ in, four deviations above the mean."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * p + 4 * np.sqrt(bits * p * (1 - p)))


def _set_prints(size: int):
    """A row per text: its keys, its distinct shingles (all of a short text, none of a longer one), their number, their digest and fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, counts, digests, short = [], [], [], []
            for part in hashed_slices(batch.column("text"), size):
                hashes, offsets = _distinct(*part)
                prints.append(_families(hashes, offsets))
                n = np.diff(offsets)
                counts.append(n)
                digests += [xxhash.xxh64_intdigest(hashes[a:b].tobytes()) for a, b in zip(offsets, offsets[1:])]
                short += [hashes[a:b].view(np.int64) if b - a <= SHORT else [] for a, b in zip(offsets, offsets[1:])]
            wide = np.concatenate(prints, axis=1) if prints else np.zeros((FAMILIES, 0), np.uint64)
            n = np.concatenate([*counts, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(np.array(digests, dtype=np.uint64).view(np.int64)), pa.array(n),
                 pa.array(short, pa.list_(pa.int64())), *(pa.array(p.view(np.int64)) for p in wide)],
                names=["doc_id", "text_key", "id", "n", "hashes", *(f"w{k}" for k in range(FAMILIES))])

    return run


def _shingle_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in hashed_slices(batch.column("text"), size):
                hashes, offsets = _distinct(*part)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(lists)), lists], names=["id", "hashes"])
                at += len(lists)

    return run


def short_links(sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): links that connect all of `sets(id, n, hashes)` that may be as similar: two such sets share one of the rarest shingles of
    either, as many of them as may be missing in the other and one more. All sets with a shingle hang on the smallest id among them, so a
    frequent shingle costs a row per set."""
    each = materialize(sets.filter("n > 0").select("id", "n", F.explode("hashes").alias("h")), "short-shingles")
    ranked = each.join(each.groupBy("h").agg(F.count("*").alias("c")), "h").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("by"))
    lead = (F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1).cast("int")
    rare = materialize(ranked.select("id", F.explode(F.slice("by", F.lit(1), lead)).alias("k")).filter("k.c > 1").select("id", F.col("k.h").alias("h")), "short-leads")
    first = rare.groupBy("h").agg(F.min("id").alias("v"))
    return rare.join(first, "h").filter("id <> v").select(F.col("id").alias("u"), "v").distinct()


VERIFIED = 1 << 20  # shingles of the texts of one block of a group; a task compares two blocks at most


def alike(bounds: np.ndarray, codes: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links (text, text) of a spanning forest of all pairs of texts with this Jaccard similarity, text i having the distinct
    codes[bounds[i]:bounds[i + 1]]. A text is compared with all that no link has reached yet; what it reaches is compared in turn."""
    sizes = np.diff(bounds)
    mark = np.zeros(int(codes.max()) + 1 if len(codes) else 1, dtype=bool)
    left = np.arange(len(sizes))  # not reached yet
    out, todo = [], []
    while todo or len(left):
        if todo:
            at = todo.pop()
        else:
            at, left = int(left[0]), left[1:]
        own = codes[bounds[at] : bounds[at + 1]]
        fit = left[(sizes[left] >= len(own) * similarity - 1e-9) & (sizes[left] * similarity - 1e-9 <= len(own))]
        if not len(fit):
            continue
        mark[own] = True
        n = sizes[fit]
        ends = np.cumsum(n)
        hits = np.append(0, np.cumsum(mark[codes[np.repeat(bounds[fit] - (ends - n), n) + np.arange(ends[-1])]]))
        mark[own] = False
        both = hits[ends] - hits[ends - n]
        near = fit[both >= (len(own) + n - both) * similarity - 1e-9]
        if len(near):
            out += [(at, k) for k in near.tolist()]
            todo += near.tolist()
            left = np.setdiff1d(left, near, assume_unique=True)
    return out


def _verified(similarity: float):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("component").combine_chunks()
        ids, group = rows.column("id").to_numpy(), rows.column("component").to_numpy()
        lists = rows.column("hashes").chunk(0) if rows.num_rows else pa.array([], pa.list_(pa.int64()))
        bounds = np.asarray(lists.offsets, dtype=np.int64)
        codes = np.unique(np.asarray(lists.values)[bounds[0] : bounds[-1]], return_inverse=True)[1]
        bounds = bounds - bounds[0]
        u, v = [], []
        cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1])).tolist() + [len(group)]
        for a, b in zip(cuts, cuts[1:]):
            part = codes[bounds[a] : bounds[b]]
            part = np.unique(part, return_inverse=True)[1]
            for x, y in alike(bounds[a : b + 1] - bounds[a], part, similarity):
                u.append(ids[a + x])
                v.append(ids[a + y])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def similar_links(groups: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """(u, v): links that connect all texts of a group whose sets of shingles have this Jaccard similarity. `groups(id, component,
    text_key, n)` has a row per text, n shingles each. A group of more than VERIFIED shingles is dealt into blocks, and each pair of its
    blocks is a task; smaller groups share tasks. A task returns a forest, never pairs, so what comes out grows with the texts."""
    sizes = groups.groupBy("component").agg(F.sum("n").alias("total"), F.count("*").alias("texts")).filter("texts > 1").select(
        "component", "total", F.ceil(F.col("total") / VERIFIED).cast("int").alias("blocks"))
    placed = materialize(groups.join(sizes, "component").select("id", "component", "text_key", "total", "blocks", "n"), "groups")
    shared = placed.filter("blocks = 1").agg(F.sum("n").alias("n")).first().n or 0
    once = texts.join(placed.select("id", "text_key"), "text_key").groupBy("id").agg(F.min("text").alias("text"))
    sets = once.mapInArrow(_shingle_sets(size), "id long, hashes array<long>").join(placed.drop("text_key", "n"), "id")
    few = sets.filter("blocks = 1").select(
        F.lit(0).alias("kind"), F.pmod(F.xxhash64("component"), F.lit(1 + shared // VERIFIED)).alias("key"), F.lit(0).alias("x"), F.lit(0).alias("y"), "component", "id", "hashes")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    many = sets.filter("blocks > 1").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.lit(1).alias("kind"), F.col("component").alias("key"), F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "component", "id", "hashes")
    return few.unionByName(many).groupBy("kind", "key", "x", "y").applyInArrow(_verified(similarity), "u long, v long").distinct()


def near_copies(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, text_key, component, component_id): texts are linked if the Jaccard similarity of their sets of shingles is at least
    `similarity`. Components are of texts (text_key is their XXH64), so different texts of one id stay apart; component_id is the
    smallest doc_id of a component.

    About 15 % of the bits of two texts at 0.8 differ, too many for one trie with a small budget. So a text gets eight fingerprints of
    64 bits, and texts are candidates where any of the sixteen halves differs in at most four bits and all fingerprints together in no
    more than four deviations above the mean: all pairs but one in ten thousand at 0.8, fewer above. Short texts are candidates by
    their rarest shingles, without a loss. Candidate links are kept as forests; the groups that they make are then compared by the
    shingles themselves, every text with those of its group that no confirmed link has reached."""
    words = [f"w{k}" for k in range(FAMILIES)]
    keyed = with_text(docs).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    schema = "doc_id long, text_key long, id long, n long, hashes array<long>, " + ", ".join(f"{w} long" for w in words)
    prints = materialize(keyed.mapInArrow(_set_prints(size), schema), "simhash")
    classes = materialize(prints.groupBy("id").agg(
        F.min("text_key").alias("text_key"), F.min("n").alias("n"), F.min("hashes").alias("hashes"), *(F.min(w).alias(w) for w in words)), "prints")
    checks = tuple(words[:CHECKS])
    # a set longer than the short ones is similar only to sets that are nearly as long
    long = classes.filter(F.col("n") >= (SHORT + 1) * similarity - 1e-9)
    near = hamming_links(long, [(w, low) for w in words for low in (0, HALF)], HALF_BUDGET, long.count(), HALF, checks, allowed_bits(similarity, BITS * CHECKS))
    loose = near.unionByName(short_links(classes.filter(F.col("n") <= SHORT).select("id", "n", "hashes"), similarity))
    groups = classes.select("id", "text_key", "n").join(connected_components(loose), "id")
    links = similar_links(groups, keyed, size, similarity)
    comp = connected_components(links)
    whole = prints.select("doc_id", "text_key", "id").join(comp, "id", "left").select("doc_id", "text_key", F.coalesce("component", "id").alias("component"))
    named = whole.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return whole.join(named, "component").select("doc_id", "text_key", "component", "component_id")


@query("op6_simhash")
def op6_simhash(spark, sf_dir):
    out = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), size=4, budget=4)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
