"""Exact cosine search over vector tables: similar pairs of one table, and top-k for a table of queries.

Vector products are the one place where rows leave the JVM: Arrow batches become numpy matrices, so a block of a few
thousand rows costs one matrix product. Spark decides which blocks meet.

Pairs. Vectors are put into cells (nearest of a few pivot vectors) and rings (angle to the pivot), and large rings are
cut by hash, so that a block holds about `block_rows` rows however dense the data is. By the triangle inequality for
angles two rings can only hold a similar pair if their distance allows it; only those blocks meet. What is moved is a row
for each meeting it goes to, so blocks meet by groups: up to a million vectors there are about `GROUPS` groups, whatever the
number of rows; beyond that a group holds `GROUP_ROWS`, which bounds a task's memory. Inside a meeting one pair of blocks is multiplied at
a time. Identical vectors are collapsed first, so a group of copies counts once. Nothing is capped: the result equals brute
force.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.operators.dedup import grid_forest
from storyloom.session import materialize

BLOCK_ROWS = 4096
GROUPS, GROUP_ROWS = 16, 65_536
MAX_PIVOTS = 128
RING_RADIANS = math.radians(6)
QUERY_BLOCK = 4096


def _matrix(col) -> np.ndarray:
    """A numpy matrix from an Arrow list column without NULL rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if n == 0:
        return np.zeros((0, 0))
    return col.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)


def _unit(m: np.ndarray) -> np.ndarray:
    if m.size == 0:
        return m
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _best(cos: np.ndarray, ids: np.ndarray, k: int, floor: float):
    """Positions (row, column) of the top k per row with cos >= floor; ties go to the smaller id."""
    if k < cos.shape[1] and cos.size:  # the k-th best value of a row; what ties with it stays until ids decide
        floor = np.maximum(np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k], floor)[:, None]
    r, c = np.nonzero(cos >= floor)
    order = np.lexsort((ids[c], -cos[r, c], r))
    r, c = r[order], c[order]
    nth = np.arange(len(r)) - np.searchsorted(r, r)
    return r[nth < k], c[nth < k]


def _nonzero(vectors: DataFrame) -> DataFrame:
    return vectors.filter(F.col("vec").isNotNull() & F.exists("vec", lambda x: x != 0))


def _with_cells(reps: DataFrame, pivots: np.ndarray) -> DataFrame:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            cos = np.clip(_unit(_matrix(b.column("vec"))) @ pivots.T, -1.0, 1.0)
            cell = cos.argmax(axis=1)
            angle = np.arccos(cos[np.arange(len(cell)), cell])
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("vec"), pa.array(cell.astype(np.int32)), pa.array(angle)],
                names=["id", "vec", "cell", "angle"],
            )

    return reps.mapInArrow(place, "id long, vec array<float>, cell int, angle double")


class _Rings:
    """Places of the rings, by number, and whether two of them may hold vectors within `max_angle` of each other."""

    def __init__(self, rings: list, pivots: np.ndarray, max_angle: float):
        self.between = np.arccos(np.clip(pivots @ pivots.T, -1.0, 1.0))
        self.cell = np.array([r["cell"] for r in rings])
        self.lo, self.hi = np.array([r["lo"] for r in rings]), np.array([r["hi"] for r in rings])
        self.max_angle = max_angle

    def may_meet(self, a: int, others: np.ndarray) -> np.ndarray:
        gap, lo, hi = self.between[self.cell[a], self.cell[others]], self.lo[others], self.hi[others]
        low = np.maximum.reduce([gap - self.hi[a] - hi, self.lo[a] - gap - hi, lo - gap - self.hi[a]])
        return low <= self.max_angle + 1e-9


def _grouped(sizes: list[int], rows: int) -> tuple[list[int], list[int]]:
    """(group of each ring, parts of each group): neighbouring rings share a group of up to about `rows` rows, and a ring that is larger
    has one of its own, which is cut into parts."""
    group, parts, held = [], [], 0
    for n in sizes:
        if not parts or parts[-1] > 1 or held + n > rows:
            parts.append(max(1, math.ceil(n / rows)))
            held = 0
        held += n
        group.append(len(parts) - 1)
    return group, parts


def _blocks(rings: np.ndarray, rows: np.ndarray, block_rows: int) -> list[tuple[int, np.ndarray]]:
    """(ring, rows) of the blocks of one side of a meeting: rows of one ring, at most `block_rows` of them."""
    order = rows[np.argsort(rings[rows], kind="stable")]
    numbers, first = np.unique(rings[order], return_index=True)
    return [(int(no), own[i : i + block_rows]) for no, own in zip(numbers, np.split(order, first[1:])) for i in range(0, len(own), block_rows)]


def _meetings(reps: DataFrame, min_cos: float, block_rows: int) -> tuple[DataFrame, _Rings] | None:
    """(rows, rings) of the meetings (a, p, b, q) of groups a <= b and their parts p and q; a row of `reps(id, vec)` comes once for each
    meeting that it goes to. None without a row."""
    spark = reps.sparkSession
    total = reps.count()
    n_pivots = max(1, min(MAX_PIVOTS, total // block_rows))
    # a bounded, repeatable choice of pivots
    chosen = reps.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(n_pivots).collect()
    if not chosen:
        return None
    pivots = _unit(np.array([r.vec for r in chosen], dtype=np.float64))
    placed = materialize(_with_cells(reps, pivots), "cells")
    in_cell = Window.partitionBy("cell")
    # one row per (cell, ring): at most pivots x rings, whatever the data size
    stats = placed.groupBy("cell", F.floor(F.col("angle") / RING_RADIANS).cast("int").alias("ring")).agg(
        F.count("*").alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi")
    )
    stats = stats.withColumn("ring_kept", F.when(F.sum("n").over(in_cell) > block_rows, F.col("ring")).otherwise(-1))
    rings = (
        stats.groupBy("cell", "ring_kept")
        .agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .orderBy("cell", "ring_kept")
        .collect()
    )
    places = _Rings(rings, pivots, math.acos(max(-1.0, min(1.0, min_cos))))
    group, parts = _grouped([r["n"] for r in rings], max(block_rows, min(GROUP_ROWS, math.ceil(total / GROUPS))))
    # which groups a ring meets, itself on the left (a) or on the right (b): at most rings x groups rows, bounded by pivots x rings
    of = np.array(group)
    meets = [(no, g) for no in range(len(rings)) for g in np.unique(of[places.may_meet(no, np.arange(len(rings)))]).tolist()]
    left_df = spark.createDataFrame([(no, g, parts[g]) for no, g in meets if group[no] <= g], "ring_no int, b int, n_other int")
    right_df = spark.createDataFrame([(no, g, parts[g]) for no, g in meets if g <= group[no]], "ring_no int, a int, n_other int")
    ring_df = spark.createDataFrame(
        [(r["cell"], r["ring_kept"], no, group[no], parts[group[no]]) for no, r in enumerate(rings)], "cell int, ring int, no int, grp int, parts int"
    )
    whole = ring_df.filter("ring = -1").select("cell", *[F.col(x).alias(f"whole_{x}") for x in ("no", "grp", "parts")])
    by_ring = ring_df.filter("ring >= 0")
    located = (
        placed.withColumn("ring", F.floor(F.col("angle") / RING_RADIANS).cast("int"))
        .join(F.broadcast(by_ring), ["cell", "ring"], "left")  # a row per ring: bounded by pivots x rings
        .join(F.broadcast(whole), "cell", "left")
        .select("id", "vec", *[F.coalesce(x, f"whole_{x}").alias(x) for x in ("no", "grp", "parts")])
        .select("id", "vec", F.col("no").alias("ring_no"), "grp", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    )
    seq = F.explode(F.sequence(F.lit(0), F.col("n_other") - 1))
    left = (
        located.join(left_df, "ring_no")
        .select("id", "vec", "ring_no", F.col("grp").alias("a"), F.col("part").alias("p"), "b", seq.alias("q"), F.lit(0).alias("side"))
        .filter("a < b or p <= q")
    )
    right = (
        located.join(right_df, "ring_no")
        .select("id", "vec", "ring_no", "a", seq.alias("p"), F.col("grp").alias("b"), F.col("part").alias("q"), F.lit(1).alias("side"))
        .filter("a < b or p < q")
    )
    return left.unionByName(right), places


def similar_representatives(reps: DataFrame, min_cos: float, k: int | None, block_rows: int = BLOCK_ROWS, spanning: bool = False) -> DataFrame:
    """(id, other, cos) in both directions for all pairs of `reps(id, vec)` with cos >= min_cos; with `k` at least the
    best k of each id (ties to smaller ids), possibly a few more; `spanning`: links (id, other, null) that connect what all
    those pairs connect, a forest for each meeting of blocks."""
    schema = "id long, other long, cos double"
    meetings = _meetings(reps, min_cos, block_rows)
    if meetings is None:
        return reps.sparkSession.createDataFrame([], schema)
    rows, places = meetings

    def meet(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        ids = t.column("id").to_numpy()
        ring_no = t.column("ring_no").to_numpy()
        m = _unit(_matrix(t.column("vec")))
        alone = bool((t.column("a").to_numpy() == t.column("b").to_numpy()).all() and (t.column("p").to_numpy() == t.column("q").to_numpy()).all())
        lefts = _blocks(ring_no, np.flatnonzero(side == 0), block_rows)
        rights = lefts if alone else _blocks(ring_no, np.flatnonzero(side == 1), block_rows)
        met = np.array([no for no, _ in rights], dtype=np.int64)
        limit = k if k is not None else len(ids) + 1
        found = [(ids[:0], ids[:0], np.zeros(0))]
        for i, (no, li) in enumerate(lefts):
            for j in np.flatnonzero(places.may_meet(no, met)).tolist():
                if alone and j < i:
                    continue
                ri, same = rights[j][1], alone and i == j
                cos = m[li] @ m[ri].T
                if spanning:
                    near = cos >= min_cos
                    if same:
                        np.fill_diagonal(near, True)  # a row and the column of the same vector are one
                    r, c = grid_forest(near)
                    real = ids[li][r] != ids[ri][c]
                    found.append((ids[li][r][real], ids[ri][c][real], np.zeros(int(real.sum()))))
                    continue
                if same:
                    np.fill_diagonal(cos, -2.0)
                r, c = _best(cos, ids[ri], limit, min_cos)
                found.append((ids[li][r], ids[ri][c], cos[r, c]))
                if not same:
                    r, c = _best(cos.T, ids[li], limit, min_cos)
                    found.append((ids[ri][r], ids[li][c], cos.T[r, c]))
        one, other, cos = (np.concatenate(x) for x in zip(*found))
        if spanning:
            return pa.table({"id": one, "other": other, "cos": pa.nulls(len(one), pa.float64())})
        order = np.lexsort((other, -cos, one))  # the best of all blocks of the meeting
        order = order[np.arange(len(order)) - np.searchsorted(one[order], one[order]) < limit]
        return pa.table({"id": one[order], "other": other[order], "cos": cos[order]})

    return rows.groupBy("a", "p", "b", "q").applyInArrow(meet, schema)


def neighbours(vectors: DataFrame, min_cos: float, k: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, neighbour_id, cos, rank): for each item the k most similar others with cos >= min_cos, best first, ties to
    the smaller id."""
    v = _nonzero(vectors.select("id", F.col("vec").cast("array<float>").alias("vec")))
    # first k + 1 ids of each group of identical vectors: enough to answer any member
    first = Window.partitionBy("vec").orderBy("id")
    heads = v.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= k + 1)
    reps = materialize(
        heads.groupBy("vec").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids")), "reps"
    )
    similar = similar_representatives(reps.select("id", "vec"), min_cos, k, block_rows)
    members = reps.select(F.col("id").alias("other"), "ids")
    partner = similar.join(members, "other").select(F.col("id").alias("rep"), F.explode("ids").alias("neighbour_id"), "cos")
    own = reps.filter(F.size("ids") > 1).select(F.col("id").alias("rep"), F.explode("ids").alias("neighbour_id"), F.lit(1.0).alias("cos"))
    best = Window.partitionBy("rep").orderBy(F.desc("cos"), "neighbour_id")
    lists = (
        partner.unionByName(own if min_cos <= 1.0 else own.limit(0))
        .withColumn("_rn", F.row_number().over(best))
        .filter(F.col("_rn") <= k + 1)
        .groupBy("rep")
        .agg(F.sort_array(F.collect_list(F.struct("_rn", "neighbour_id", "cos"))).alias("found"))
    )
    # every item takes its representative's list without itself
    to_rep = v.join(reps.select(F.col("id").alias("rep"), "vec"), "vec").select("id", "rep")
    mine = to_rep.join(lists, "rep").select(
        "id", F.slice(F.filter("found", lambda f: f["neighbour_id"] != F.col("id")), 1, k).alias("found")
    )
    return mine.select("id", F.posexplode("found").alias("pos", "f")).select(
        "id", F.col("f.neighbour_id").alias("neighbour_id"), F.col("f.cos").alias("cos"), (F.col("pos") + 1).alias("rank")
    )


def linked(vectors: DataFrame, min_cos: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, neighbour_id): links that connect all of `vectors(id, vec)` with cos >= min_cos, directly or by others. Equal vectors
    hang on the smallest id of theirs, so copies take no place from other neighbours."""
    v = _nonzero(vectors.select("id", F.col("vec").cast("array<float>").alias("vec")))
    reps = materialize(v.groupBy("vec").agg(F.min("id").alias("rep")), "reps")
    copies = v.join(reps, "vec").filter("id <> rep").select("id", F.col("rep").alias("neighbour_id"))
    pairs = similar_representatives(reps.select(F.col("rep").alias("id"), "vec"), min_cos, None, block_rows, spanning=True)
    return pairs.select("id", F.col("other").alias("neighbour_id")).unionByName(copies if min_cos <= 1.0 else copies.limit(0))


def _met(queries: DataFrame, vectors: DataFrame, meet, schema: str) -> DataFrame:
    """`meet(query ids, vector ids, cosines)` for every block of `queries(id, vec)` with every block of `vectors(id, vec)`, dealt by a hash
    of their ids; a meeting is one task's matrix product. No row passes through the driver."""
    q_blocks, v_blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK)), max(1, math.ceil(vectors.count() / BLOCK_ROWS))
    empty = pa.schema([(f.split()[0], pa.float64() if f.split()[1] == "double" else pa.int64()) for f in schema.split(", ")]).empty_table()

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int, side: int) -> DataFrame:
        return df.select("id", "vec", F.lit(side).alias("side"), F.pmod(F.xxhash64("id"), F.lit(n_own)).cast("int").alias(own),
                         F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other))

    def run(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        asked, met = t.filter(pa.array(side == 0)), t.filter(pa.array(side == 1))
        q_ids, ids = asked.column("id").to_numpy(), met.column("id").to_numpy()
        if not len(q_ids) or not len(ids):
            return empty
        return meet(q_ids, ids, _unit(_matrix(asked.column("vec"))) @ _unit(_matrix(met.column("vec"))).T)

    both = dealt(queries, "qb", q_blocks, "vb", v_blocks, 0).unionByName(dealt(vectors, "vb", v_blocks, "qb", q_blocks, 1))
    return both.groupBy("qb", "vb").applyInArrow(run, schema)


def _asked(queries: DataFrame) -> DataFrame:
    return queries.filter(F.col("query_vec").isNotNull()).select(
        F.col("query_id").cast("long").alias("id"), F.col("query_vec").cast("array<float>").alias("vec"))


def _known(vectors: DataFrame) -> DataFrame:
    return _nonzero(vectors.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<float>").alias("vec")))


def linked_between(queries: DataFrame, vectors: DataFrame, min_cos: float) -> DataFrame:
    """(query_id, id): links that connect what all pairs of `queries(query_id, query_vec)` and `vectors(id, vec)` with cos >= min_cos
    connect; a forest for each meeting of blocks, never the pairs."""

    def meet(q_ids: np.ndarray, ids: np.ndarray, cos: np.ndarray) -> pa.Table:
        r, c = grid_forest(cos >= min_cos)
        return pa.table({"query_id": q_ids[r], "id": ids[c]})

    return _met(_asked(queries), _known(vectors), meet, "query_id long, id long")


def search(queries: DataFrame, vectors: DataFrame, k: int, min_cos: float, exclude_self: bool = False) -> DataFrame:
    """(query_id, id, cos, rank): top k of `vectors(id, vec)` for each of `queries(query_id, query_vec)`, rank from 0. Every meeting of
    blocks keeps the best k per query."""

    def meet(q_ids: np.ndarray, ids: np.ndarray, cos: np.ndarray) -> pa.Table:
        if exclude_self:
            cos[q_ids[:, None] == ids[None, :]] = -2.0
        r, c = _best(cos, ids, k, min_cos)
        return pa.table({"query_id": q_ids[r], "id": ids[c], "cos": cos[r, c]})

    found = _met(_asked(queries), _known(vectors), meet, "query_id long, id long, cos double")
    best = Window.partitionBy("query_id").orderBy(F.desc("cos"), "id")
    return found.withColumn("rank", F.row_number().over(best) - 1).filter(F.col("rank") < k)
