"""Story clusters: equal canonical URL, similar vectors, connected components, incremental assignment."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.session import materialize

MAX_ROUNDS = 100


def _story_key(key: Column) -> Column:
    """Items without a key stand alone; keys of their own also keep NULLs from meeting in one task."""
    return F.coalesce(key, F.concat(F.lit("item:"), F.col("id").cast("string")))


def clusters_by(items: DataFrame, key: Column) -> DataFrame:
    """(key, cluster_id, representative_id, size): one row per group of equal keys, combined on the map side."""
    return (
        items.select("id", "fetched_at", _story_key(key).alias("story_key"))
        .groupBy("story_key")
        .agg(
            F.min("id").alias("cluster_id"),
            F.min_by("id", F.struct("fetched_at", "id")).alias("representative_id"),
            F.count("*").alias("size"),
        )
    )


def assign_by(items: DataFrame, key: Column) -> DataFrame:
    """(id, cluster_id, representative_id, size) of every item. The cluster side of the join has one row per key, so a
    key shared by a third of the items only skews the item side, which adaptive execution splits."""
    keyed = items.select("id", _story_key(key).alias("story_key"))
    return keyed.join(clusters_by(items, key), "story_key").drop("story_key")


def grid_forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) links of a spanning forest of the true places of a matrix: rows and columns are the two sides of a graph. Each
    row and each column is looked at once, as an array, so a dense matrix costs no more than its size."""
    rows, cols = np.ones(near.shape[0], dtype=bool), np.ones(near.shape[1], dtype=bool)
    out_r, out_c = [], []
    for start in np.flatnonzero(near.any(axis=1)).tolist():
        if not rows[start]:
            continue
        rows[start] = False
        front = np.array([start])
        while len(front):
            open_cols = np.flatnonzero(cols)
            hit = near[np.ix_(front, open_cols)]
            new = hit.any(axis=0)
            found = open_cols[new]
            out_r.append(front[hit[:, new].argmax(axis=0)])
            out_c.append(found)
            cols[found] = False
            open_rows = np.flatnonzero(rows)
            back = near[np.ix_(open_rows, found)]
            again = back.any(axis=1)
            front = open_rows[again]
            out_r.append(front)
            out_c.append(found[back[again].argmax(axis=1)] if len(front) else front)
            rows[front] = False
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([*out_r, none]), np.concatenate([*out_c, none])


def _mark(edges: DataFrame) -> tuple:
    """((number, checksum), most): what tells one round's edges from another's, and the most edges that end in one vertex."""
    per = edges.groupBy("v").agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    r = per.agg(F.sum("n").alias("n"), F.sum("h").alias("h"), F.max("n").alias("most")).first()
    return (r.n or 0, r.h), r.most or 0


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the given links connect, as few as possible, each to the smallest value of its group."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
    return [(x, root(x)) for x in parent if root(x) != x]


HUB_EDGES = 4096  # a vertex with more pairs than this, and more than a thousandth of all, is a hub; at most two thousand are


def _with_minimum(pairs: DataFrame, low: DataFrame, hub: int | None) -> DataFrame:
    """`pairs(u, v)` with the `m` of u in `low(u, m, n)`, n being u's pairs. The minima of vertices with more than `hub` pairs, whose number
    is bounded, are sent to the pairs, so that a hub's pairs stay where they are; all others meet on u."""
    if hub is None:
        return pairs.join(low.select("u", "m"), "u")
    hot = low.filter(F.col("n") > hub)
    marked = pairs.join(F.broadcast(hot.select("u", F.col("m").alias("_hub"))), "u", "left")
    rest = marked.filter("_hub is null").select("u", "v").join(low.select("u", "m"), "u")
    return marked.filter("_hub is not null").select("u", "v", F.col("_hub").alias("m")).unionByName(rest)


def connected_components(edges: DataFrame, hub_edges: int = HUB_EDGES) -> DataFrame:
    """(id, component) of every vertex of `edges(u, v)`; the component is its smallest vertex.

    Alternates two steps until nothing changes: connect the larger neighbours of each vertex to its smallest neighbour,
    then the smaller ones. Each step is a grouped minimum (combined on the map side) joined back to the edges; no
    neighbour list is ever collected, and while a vertex has more than `hub_edges` of them, the edges of such a vertex are not moved to one
    task. Every round is written to the shared folder: lineage stays short and a lost executor costs one round at most."""
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, "edges")
    mark, most = _mark(edges)
    for _ in range(MAX_ROUNDS):
        hub = max(hub_edges, mark[0] // 1000) if most > hub_edges else None
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _with_minimum(both.filter("v > u"), low, hub).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low2 = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_minimum(down, low2, hub)
        nxt = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .filter("u <> v")
            .distinct()
        )
        edges = materialize(nxt, "edges")
        new_mark, most = _mark(edges)
        if new_mark == mark:
            roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
        mark = new_mark
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def merge_clusters(assigned: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(id, cluster_id, size) after joining clusters that hold similar items: components over cluster links.

    `assigned(id, cluster_id)` comes from the URL step, `neighbours(id, neighbour_id)` from the vector step. Links are
    drawn between clusters, not items, so copies of one story do not multiply the edges."""
    side = materialize(assigned.select("id", "cluster_id"), "assigned")  # read three times below
    links = (
        neighbours.select("id", "neighbour_id")
        .join(side, "id")
        .join(side.select(F.col("id").alias("neighbour_id"), F.col("cluster_id").alias("other")), "neighbour_id")
        .select(F.col("cluster_id").alias("u"), F.col("other").alias("v"))
    )
    comp = connected_components(links).select(F.col("id").alias("cluster_id"), "component")
    merged = side.join(comp, "cluster_id", "left").select("id", F.coalesce("component", "cluster_id").alias("cluster_id"))
    sizes = merged.groupBy("cluster_id").agg(F.count("*").alias("size"))
    return merged.join(sizes, "cluster_id").select("id", "cluster_id", "size")
