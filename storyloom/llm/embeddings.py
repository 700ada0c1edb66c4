"""Embedding near-duplicates by collision-counting projections.

Vectors of length one are projected on `PROJECTIONS` random directions. Two vectors within the wanted cosine lie close on each
of them: the difference of their projections is about normal with a deviation of distance / sqrt(dimensions), so with a window of
three deviations around a query nearly every projection collides for a near pair, and about half of them for a pair at random.
A pair is verified, by cosine in double precision, if its collisions reach a count that loses less than one near pair in ten
thousand by the binomial tail.

Rows are ordered by the first projection, in cells of a quarter window, and cells are dealt into blocks of bounded size; only blocks
of cells within a window can hold a pair that collides there, and a table of those pairs of blocks, joined by cell, sends each
row where it is needed. For a pair of blocks a task sorts the rows of one side along each projection and counts, for every query
of the other side, the collisions inside its window: the first projections for all pairs, the rest for pairs that can still reach
the count. A pair must collide on the first projection, so its window is wider there. Equal vectors are collapsed before and
counted by their multiplicity; a task returns link counts for each row and the links of a spanning forest, never the pairs.
Vectors without any structure still make the work grow with the square of their number, split over bounded tasks.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing, and so do vectors of
different sizes with each other; repeated rows are vectors of their own; repeated ids share a component and are counted each;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from math import comb, erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import bounded_batches, table
from storyloom.llm.registry import query
from storyloom.operators.dedup import connected_components, forest
from storyloom.session import materialize

PROJECTIONS, FIRST = 32, 8  # directions; those counted for every pair of a block pair
DEVIATIONS, FIRST_DEVIATIONS = 3.0, 3.9
CELLS = 4  # cells of a window along the first projection
LOSS = 1e-4  # near pairs that the count may lose
BLOCK = 2048


def least_count(n: int, hit: float, loss: float) -> int:
    """The largest count that a near pair, hitting each of n windows with chance `hit`, reaches but for `loss`."""
    tail, k = 0.0, 0
    while tail + comb(n, k) * hit**k * (1 - hit) ** (n - k) <= loss:
        tail += comb(n, k) * hit**k * (1 - hit) ** (n - k)
        k += 1
    return k


class Projector:
    def __init__(self, size: int, cosine: float):
        directions = np.random.default_rng(11).standard_normal((size, PROJECTIONS))
        self.directions = directions / np.linalg.norm(directions, axis=0)
        deviation = sqrt(2 - 2 * cosine) / sqrt(size)
        self.windows = np.full(PROJECTIONS, DEVIATIONS * deviation)
        self.windows[0] = FIRST_DEVIATIONS * deviation
        hit = erf(DEVIATIONS / sqrt(2))
        self.least_first, self.least = least_count(FIRST - 1, hit, LOSS) + 1, least_count(PROJECTIONS - 1, hit, LOSS) + 1

    def project(self, x: np.ndarray) -> np.ndarray:
        return x @ self.directions


def candidates(p: np.ndarray, q: np.ndarray, windows: np.ndarray, least_first: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of queries p and rows q whose projections collide often enough. Along each direction the rows are sorted, and a
    query's window is a range of that order; counts of all pairs are kept in one byte each."""
    counts = np.zeros((len(p), len(q)), dtype=np.uint8)
    for k in range(FIRST):
        order = np.argsort(q[:, k])
        along = q[order, k]
        lo = np.searchsorted(along, p[:, k] - windows[k], side="left")
        hi = np.searchsorted(along, p[:, k] + windows[k], side="right")
        rank = np.empty(len(q), dtype=np.int16)
        rank[order] = np.arange(len(q))
        counts += (rank >= lo.astype(np.int16)[:, None]) & (rank < hi.astype(np.int16)[:, None])
    i, j = np.nonzero(counts >= least_first)
    n = counts[i, j].astype(np.int64)
    for k in range(FIRST, PROJECTIONS):
        n += np.abs(p[i, k] - q[j, k]) <= windows[k]
        alive = n + (PROJECTIONS - 1 - k) >= least
        i, j, n = i[alive], j[alive], n[alive]
    return i, j


def _join_blocks(projector: Projector, cosine: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        ids, n, side = rows["id"].to_numpy(), rows["n"].to_numpy(), rows["side"].to_numpy()
        left, right = np.flatnonzero(side <= 1), np.flatnonzero(side >= 1)  # 1: a block that meets itself
        p = projector.project(x)
        i, j = candidates(p[left], p[right], projector.windows, projector.least_first, projector.least)
        i, j = left[i], right[j]
        if (side == 1).any():
            i, j = i[i < j], j[i < j]
        near = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 65536]], x[j[k : k + 65536]]) >= cosine for k in range(0, len(i), 65536)] or [np.zeros(0, bool)])
        i, j = i[near], j[near]
        links = np.bincount(i, n[j], len(ids)) + np.bincount(j, n[i], len(ids))
        some, tree = np.flatnonzero(links), np.array(forest(ids[i], ids[j]), dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({
            "id": np.concatenate([ids[some], tree[:, 0]]), "links": np.concatenate([links[some].astype(np.int64), np.zeros(len(tree), np.int64)]),
            "v": pd.array(np.concatenate([ids[some], tree[:, 1]]), dtype="Int64"), "is_link": np.arange(len(some) + len(tree)) >= len(some)})

    return run


def _links_of_size(classes: DataFrame, size: int, cosine: float, block: int) -> DataFrame:
    """(id, links, v, is_link): link counts by row (is_link false), and the links (id, v) of a forest, from each pair of blocks."""
    projector = Projector(size, cosine)
    ramp = F.array(*(F.lit(float(d)) for d in projector.directions[:, 0]))
    along = F.aggregate(F.zip_with("unit", ramp, lambda x, d: x * d), F.lit(0.0), lambda s, x: s + x)
    placed = classes.select("id", "n", "embedding", F.floor(along / (projector.windows[0] / CELLS)).cast("long").alias("cell"))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(block)).cast("long").alias("blocks"))
    blocks = materialize(sizes.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")), "vector-blocks")
    reach = blocks.select(F.col("cell").alias("x_cell"), F.col("block").alias("x"), F.explode(F.sequence(F.col("cell"), F.col("cell") + CELLS)).alias("cell"))
    pairs = reach.join(blocks, "cell").select("x_cell", "x", F.col("cell").alias("y_cell"), F.col("block").alias("y")).filter("x_cell < y_cell or x <= y")
    same = (F.col("x_cell") == F.col("y_cell")) & (F.col("x") == F.col("y"))
    sides = F.when(same, F.array(F.struct(F.col("x_cell").alias("cell"), F.col("x").alias("block"), F.lit(1).alias("side")))).otherwise(F.array(
        F.struct(F.col("x_cell").alias("cell"), F.col("x").alias("block"), F.lit(0).alias("side")), F.struct(F.col("y_cell").alias("cell"), F.col("y").alias("block"), F.lit(2).alias("side"))))
    sends = pairs.select("x_cell", "x", "y_cell", "y", F.explode(sides).alias("s")).select("x_cell", "x", "y_cell", "y", "s.*")
    dealt = placed.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).drop("blocks")
    met = dealt.join(sends, ["cell", "block"]).select("x_cell", "x", "y_cell", "y", "side", "id", "n", "embedding")
    return met.groupBy("x_cell", "x", "y_cell", "y").applyInPandas(_join_blocks(projector, cosine), "id long, links long, v long, is_link boolean")


def near_vectors(vectors: DataFrame, cosine: float = 0.95, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id) of every row of `vectors(vec_id, embedding)`."""
    bounded_batches(vectors.sparkSession)
    doubles = F.col("embedding").cast("array<double>")
    finite = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists(doubles, lambda x: x != 0), F.lit(False))
    keyed = vectors.select("vec_id", "embedding", usable.alias("usable"))
    same = keyed.filter("usable").groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")).filter("id is not null")
    scaled = same.withColumn("unit", F.transform(doubles, lambda x: x / F.array_max(F.transform(doubles, F.abs))))
    norm = F.sqrt(F.aggregate("unit", F.lit(0.0), lambda s, x: s + x * x))
    classes = materialize(scaled.select("id", "n", F.size("embedding").alias("size"), "embedding", F.transform("unit", lambda x: x / norm).alias("unit")), "vectors")
    found = None
    for size in sorted(r["size"] for r in classes.select("size").distinct().collect()):
        part = _links_of_size(classes.filter(F.col("size") == size), size, cosine, block)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return keyed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    found = materialize(found, "vector-links")
    counts = found.filter("not is_link").groupBy("id").agg(F.sum("links").alias("links"))
    comp = connected_components(found.filter("is_link").select(F.col("id").alias("u"), "v"))
    known = classes.join(counts, "id", "left").join(comp, "id", "left").select(
        F.col("embedding").alias("_embedding"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("_links"), F.coalesce("component", "id").alias("_component"))
    joined = keyed.join(known, F.col("usable") & (F.col("embedding") == F.col("_embedding")), "left")
    return joined.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("_component", "vec_id").alias("component_id"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(id, other) AS (SELECT a, b FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links,
  least(e.vec_id, coalesce((SELECT min(other) FROM reach r WHERE r.id = e.vec_id), e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce((SELECT min(other) FROM reach r WHERE r.id = e.vec_id), e.vec_id)) AS kept
FROM embeddings e"""


@query("op1_near_vectors", SQL)
def op1_near_vectors(spark, sf_dir):
    found = near_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), cosine=0.95)
    return found.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
