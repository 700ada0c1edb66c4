"""Product codes of vectors, with the nearest codebook entry found in a tree of split points.

Components become integers, floor(scale * x), and a vector is cut into equal parts, each coded by the number of its nearest entry
in the part's codebook. Codebooks start as the parts of the vectors with the smallest ids and are refined by rounds of assigning and
averaging: tasks return the sum and the count of every entry, which Spark adds up; only codebooks, whose size is set by parameters, ever
reach the driver or are sent to the tasks.

A codebook is searched as a GNAT, a geometric near-neighbour access tree. A node has a few split points, far apart, and every other entry
of the node belongs to the nearest of them, its child; the node stores the range of distances from each split point to each child. A query
measures its distance to the split points; where the ball around it that holds its best entry so far cannot meet the range of a child, as
seen from any split point, the whole child is left out. Distances that decide are rounded away from elimination, and a child is left
out only if it lies strictly beyond the best distance, so entries that tie survive; they are compared as integers, the lower index first.
All queries of a block walk the tree side by side, each visiting the children of a node from its nearest split point on.

Defined results: vectors that are null or hold null or non-finite components are dropped, and so are vectors whose size is not that of
the kept vector with the smallest id or not a multiple of the number of parts, and those with a component of which scale * |x| exceeds
2^24 (sums and squares then stay exact); rows with a null id come last among the starting vectors and are coded like any other; repeated
rows and ids count each; with fewer rows than entries the codebooks are shorter; an empty table gives an empty result; labels may be null;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import bounded_batches, table
from storyloom.llm.registry import query
from storyloom.session import materialize

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
DEGREE, LEAF = 8, 8  # split points of a node; entries up to which a node is a plain list
BLOCK = 8192  # queries that walk the trees side by side
LARGEST = 1 << 24


class Node(NamedTuple):
    """A list of entries, or split points with a child each and the ranges (lo, hi) of distances from split i to child j."""

    entries: np.ndarray
    children: tuple[Node | None, ...] = ()
    lo: np.ndarray | None = None
    hi: np.ndarray | None = None


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of `a` to every row of `b`."""
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    for k in range(a.shape[1]):
        d = a[:, k, None] - b[None, :, k]
        out += d * d
    return out


def _below(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, -np.inf)


def _above(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def grow(book: np.ndarray, entries: np.ndarray | None = None) -> Node:
    """The tree over the rows of `book`. Split points are chosen one by one, each as far as possible from those before."""
    entries = np.arange(len(book)) if entries is None else entries
    if len(entries) <= LEAF:
        return Node(entries)
    picked = [0]
    apart = squares(book[entries], book[entries[:1]])[:, 0]
    while len(picked) < DEGREE and apart.max() > 0:
        picked.append(int(apart.argmax()))
        apart = np.minimum(apart, squares(book[entries], book[entries[picked[-1:]]])[:, 0])
    if len(picked) == 1:
        return Node(entries)  # all entries are equal
    splits = entries[picked]
    rest = np.delete(entries, picked)
    to = squares(book[rest], book[splits])
    own = to.argmin(axis=1)
    lo, hi, children = np.zeros((len(splits),) * 2), np.zeros((len(splits),) * 2), []
    for j in range(len(splits)):
        child = rest[own == j]
        children.append(grow(book, child) if len(child) else None)
        if len(child):  # the split points themselves are measured by every query, so the range is the child's alone
            lo[:, j] = _below(np.sqrt(to[own == j].min(axis=0).astype(np.float64)))
            hi[:, j] = _above(np.sqrt(to[own == j].max(axis=0).astype(np.float64)))
    return Node(splits, tuple(children), lo, hi)


class Search:
    """The nearest entry of a codebook for many queries at a time."""

    def __init__(self, book: np.ndarray):
        self.book, self.root = book, grow(book)

    def __call__(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(entry, squared distance) of every query, and how many distances were measured."""
        self.queries, self.measured = queries, 0
        self.entry = np.full(len(queries), -1, dtype=np.int64)
        self.best = np.full(len(queries), np.iinfo(np.int64).max, dtype=np.int64)
        if len(queries):
            self._visit(self.root, np.arange(len(queries)))
        return self.entry, self.best, self.measured

    def _visit(self, node: Node, who: np.ndarray) -> None:
        to = squares(self.queries[who], self.book[node.entries])
        self.measured += to.size
        least = to.min(axis=1)
        entry = np.where(to == least[:, None], node.entries, len(self.book)).min(axis=1)  # the lower index of a tie
        better = (least < self.best[who]) | ((least == self.best[who]) & (entry < self.entry[who]))
        self.best[who[better]], self.entry[who[better]] = least[better], entry[better]
        if not node.children:
            return
        root = np.sqrt(to.astype(np.float64))
        near, far = _below(root), _above(root)
        order = np.argsort(to, axis=1, kind="stable")
        for turn in range(len(node.entries)):
            for j, child in enumerate(node.children):
                mine = np.flatnonzero(order[:, turn] == j)
                if child is None or not len(mine):
                    continue
                ball = _above(np.sqrt(self.best[who[mine]].astype(np.float64)))[:, None]
                out = (_below(near[mine] - node.hi[:, j]) > ball) | (_below(node.lo[:, j] - far[mine]) > ball)
                mine = mine[~out.any(axis=1)]
                if len(mine):
                    self._visit(child, who[mine])


def integers(lists: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, values): the places of vectors that can be coded, of one size, and their integer components. Arrow lists in, so that null
    lists and null components are seen."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
    flat = lists.flatten()
    x = np.floor(np.asarray(pc.fill_null(flat.cast(pa.float64()), float("nan"))) * scale)
    bad = ~(np.abs(x) <= LARGEST)
    ends = np.cumsum(sizes)
    clean = np.diff(np.append(0, np.append(0, np.cumsum(bad))[ends])) == 0
    rows = np.flatnonzero(clean & (sizes > 0))
    size = sizes[rows[0]] if len(rows) else 0
    if not (sizes[rows] == size).all():
        raise ValueError("vectors of one size are expected")
    if not len(rows):
        return rows, np.zeros((0, 0), dtype=np.int64)
    at = (ends - sizes)[rows][:, None] + np.arange(size)
    return rows, x[at].astype(np.int64)


def usable(vectors: DataFrame, parts: int, scale: int) -> DataFrame:
    """The rows of `vectors(vec_id, vec, ...)` that are coded; the check is a column expression."""
    small = lambda x: F.coalesce((x.cast("double") * scale).between(-LARGEST, LARGEST), F.lit(False))  # NaN is above all numbers
    clean = F.forall("vec", small)
    kept = vectors.filter(F.col("vec").isNotNull() & (F.size("vec") > 0) & (F.size("vec") % parts == 0) & clean)
    size = kept.agg(F.min_by(F.size("vec"), F.struct(F.col("vec_id").isNull(), "vec_id", "vec")).alias("size"))
    return kept.join(F.broadcast(size), F.size("vec") == F.col("size")).drop("size")  # a table of one row


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches joined to about BLOCK rows, so that a walk through the trees serves many queries."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BLOCK:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def first_books(vectors: DataFrame, parts: int, entries: int, scale: int) -> np.ndarray:
    """(parts, entries, width): the parts of the vectors with the smallest ids."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(entries).select("vec").collect()
    if not rows:
        return np.zeros((parts, 0, 0), dtype=np.int64)
    x = np.floor(np.array([r.vec for r in rows], dtype=np.float64) * scale).astype(np.int64)
    return x.reshape(len(x), parts, -1).transpose(1, 0, 2)


def refined(vectors: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """The codebooks after one round: entries become the floor of the mean of their parts; entries without parts stay."""
    spark, (parts, entries, width) = vectors.sparkSession, books.shape
    sent = spark.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Search(b) for b in sent.value]
        sums, counts = np.zeros((parts, entries, width), dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for block in _blocks(batches):
            _, x = integers(block.column("vec").combine_chunks(), scale)
            x = x.reshape(len(x), parts, width)
            for p, search in enumerate(searches):
                entry, _, _ = search(x[:, p])
                np.add.at(sums[p], entry, x[:, p])
                counts[p] += np.bincount(entry, minlength=entries)
        p, e = np.nonzero(counts)
        wide = np.repeat(np.arange(len(p)), width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p[wide].astype(np.int32)), pa.array(e[wide].astype(np.int32)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(p))),
             pa.array(sums[p, e].reshape(-1)), pa.array(counts[p, e][wide])],
            names=["part", "entry", "place", "total", "n"])

    totals = vectors.select("vec").mapInArrow(run, "part int, entry int, place int, total long, n long")
    # one row per component of the codebooks, whose size the parameters set
    rows = totals.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    sent.destroy()
    out = books.copy()
    for r in rows:
        out[r.part, r.entry, r.place] = r.total // r.n
    return out


def fitted_books(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """(parts, entries, width) codebooks of all rows of `vectors(vec_id, vec)`, which `usable` has passed."""
    books = first_books(vectors, parts, entries, scale)
    for _ in range(rounds if books.shape[1] else 0):
        books = refined(vectors, books, scale)
    return books


def coded(vectors: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, code, error): the entry of every part as a byte, and the squared distances summed. Up to 256 entries."""
    spark, (parts, _, width) = vectors.sparkSession, books.shape
    kind = dict(vectors.dtypes)["label"]
    if not books.shape[1]:
        return spark.createDataFrame([], f"vec_id long, label {kind}, code binary, error long")
    sent = spark.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Search(b) for b in sent.value]
        for block in _blocks(batches):
            _, x = integers(block.column("vec").combine_chunks(), scale)
            x = x.reshape(len(x), parts, width)
            found = [search(x[:, p])[:2] for p, search in enumerate(searches)]
            codes = np.stack([e for e, _ in found], axis=1).astype(np.uint8)
            raw = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * parts), pa.py_buffer(codes.tobytes())])
            error = pa.array(sum(d for _, d in found))
            columns = [block.column("vec_id").combine_chunks(), block.column("label").combine_chunks(), raw, error]
            yield from pa.Table.from_arrays(columns, names=["vec_id", "label", "code", "error"]).to_batches(max_chunksize=1024)

    return vectors.select("vec_id", "label", "vec").mapInArrow(run, f"vec_id long, label {kind}, code binary, error long")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compressed(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error, label_error) of the rows of `vectors(vec_id, label, vec)` that can be coded, and the codebooks."""
    bounded_batches(vectors.sparkSession)
    kept = materialize(usable(vectors.select("vec_id", "label", "vec"), parts, scale), "vectors")
    books = fitted_books(kept, parts, entries, rounds, scale)
    codes = materialize(coded(kept, books, scale), "codes")
    by_label = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).drop("_label"), books


SQL = f"""
with kept as (
  select vec_id, label, list_transform(embedding, lambda x: floor(cast({SCALE} as double) * cast(x as double))::bigint) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
cut as (
  select k.vec_id, p.p, list_slice(k.v, p.p * len(k.v) // {PARTS} + 1, (p.p + 1) * len(k.v) // {PARTS}) as x
  from kept k cross join (select unnest(range({PARTS})) as p) p),
first as (
  select c.p, s.e, c.x from cut c
  join (select vec_id, row_number() over (order by vec_id) - 1 as e from kept order by vec_id limit {ENTRIES}) s using (vec_id)),
{{rounds}}
final as (
  select vec_id, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' order by p) as code, sum(d)::bigint as error from assigned group by vec_id),
books as (select sha256(string_agg(array_to_string(x, ','), ',' order by p, e)) as codebooks_sha256 from book{ROUNDS}),
whole as (select f.vec_id, k.label, f.code, f.error from final f join kept k using (vec_id)),
labels_ as (select label, sum(error)::bigint as label_error from whole group by label)
select w.vec_id, w.code, w.error, l.label_error, b.codebooks_sha256
from whole w join labels_ l on w.label is not distinct from l.label cross join books b
"""


def _assigned(name: str, book: str) -> str:
    near = "list_sum(list_transform(list_zip(c.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    return f"""{name} as (
  select vec_id, p, x, best[2] as e, best[1] as d from (
    select c.vec_id, c.p, any_value(c.x) as x, min([{near}::bigint, b.e]) as best from cut c join {book} b using (p) group by c.vec_id, c.p)),"""


def _rounds() -> str:
    out, book = "", "first"
    for k in range(1, ROUNDS + 1):
        out += _assigned(f"near{k}", book) + f"""
sums{k} as (select p, e, i, floor_div(sum(x[i]), count(*)) as m from near{k}, unnest(range(1, len(x) + 1)) u(i) group by p, e, i),
book{k} as (
  select b.p, b.e, coalesce(s.x, b.x) as x from {book} b left join (select p, e, list(m order by i) as x from sums{k} group by p, e) s using (p, e)),"""
        book = f"book{k}"
    return out + _assigned("assigned", book)


def twin() -> str:
    """The query in SQL, every distance measured; whole numbers are divided down by hand, since SQL's division cuts towards zero."""
    text = SQL.replace("{rounds}", _rounds())
    return text.replace("floor_div(sum(x[i]), count(*))", "(sum(x[i])::bigint - ((sum(x[i])::bigint % count(*)) + count(*)) % count(*)) // count(*)")


@query("op12_vector_codes", twin())
def op12_vector_codes(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").withColumnRenamed("embedding", "vec")
    out, books = compressed(vectors)
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
