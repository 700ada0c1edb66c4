"""A stored lexical index: postings by term and block of items, each block with its highest score, and a top-k that skips blocks.

Items are dealt into segments by a hash of their id, a segment holding a bounded number of postings, and in a segment into blocks in order
of their length, so that the items of a block score alike. A posting row is a term in a segment: the items that hold it by their place in
the segment and their counts; and for each block of them its number, its size and the highest value that one of its items adds to a score
(the impact). The row of the empty term has the ids and lengths of the segment's items. Rows lie in buckets by a hash of the term, so a
search reads the buckets of its terms. A search has two waves. The first scores, for each query, in every segment the blocks with the
highest sums of impacts; the k-th best score of all is a floor. The second scores only the blocks whose sum reaches the floor. What is left
out cannot be among the best k, so the result is that of scoring everything.

What is written and shuffled are postings, packed by item or by term: never a row per posting or per pair of item and query. A wave returns
the best k items of each segment and query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom import constants as K
from storyloom.operators.retrieval import SCORED_QUERIES, _coded, impact, search_terms, word_lists
from storyloom.session import discard, materialize, scratch_path

BLOCK_ITEMS = 2048  # items of a block, about
BUCKETS = 16
SEGMENT_POSTINGS, SEGMENT_ITEMS = 1 << 20, 1 << 14  # what a segment holds, about
COMPRESSION = "zstd"  # of the word lists and the stored postings
MARGIN = 1e-7  # scores are compared after rounding; a block this close to the floor is still looked at


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Where the lists of a column begin and end, and their values in a row."""
    lists = column.combine_chunks()
    bounds = np.asarray(lists.offsets, dtype=np.int64)
    return bounds - bounds[0], lists.flatten().to_numpy(zero_copy_only=False)


def _ranges(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The numbers from each start to before its stop, one range after the other."""
    n = stops - starts
    return np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)


def _new(*columns: np.ndarray) -> np.ndarray:
    """Where one of the columns has another value than before."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def _posting_rows(items: pa.Table, block_items: int, avg_length: float) -> pa.Table:
    """The posting rows of the items (segment, id, length, terms, tf) of one segment."""
    item, _ = _coded(items.column("id"))
    length = items.column("length").to_numpy()
    # rows that share an id are one item: they stay together, where the longest of them belongs
    longest = np.zeros(len(item), dtype=np.int64)
    np.maximum.at(longest, item, length)
    order = np.lexsort((item, longest[item]))
    items, item, length = items.take(pa.array(order)), item[order], length[order]
    first = np.zeros(len(item), dtype=np.int64)
    at = _new(item)
    first[at] = at
    block = np.maximum.accumulate(first) // block_items
    words = pc.split_pattern(items.column("terms").combine_chunks(), " ")
    term = words.flatten().dictionary_encode()
    code = np.asarray(term.indices)
    order = np.argsort(code, kind="stable")
    code, doc = code[order], np.repeat(np.arange(len(item)), np.diff(words.offsets))[order]
    tf = _flat(items.column("tf"))[1][order]
    rows, heads, own = _new(code), _new(code, block[doc]), _new(code, item[doc])
    tops = np.maximum.reduceat(np.add.reduceat(impact(tf, length[doc], avg_length), own), np.searchsorted(own, heads))
    ends = np.append(rows, len(code))
    by_term = lambda values, bounds, kind: pa.ListArray.from_arrays(pa.array(np.append(bounds, bounds[-1]), type=pa.int32()), pa.array(values, type=kind))
    head_ends = np.searchsorted(heads, ends)
    last = np.zeros(len(rows) + 2, dtype=np.int64)  # the row of the empty term comes last
    last[-1] = len(item)
    return pa.table({
        "term": pa.concat_arrays([term.dictionary.take(pa.array(code[rows])), pa.array([""])]),
        "segment": pa.repeat(items.column("segment")[0], len(rows) + 1),
        "docs": by_term(doc, ends, pa.int32()), "tf": by_term(tf, ends, pa.int32()),
        "blocks": by_term(block[doc[heads]], head_ends, pa.int32()), "counts": by_term(np.diff(np.append(heads, len(code))), head_ends, pa.int32()),
        "tops": by_term(tops, head_ends, pa.float64()),
        "ids": pa.ListArray.from_arrays(pa.array(last, type=pa.int32()), items.column("id").combine_chunks()),
        "lengths": pa.ListArray.from_arrays(pa.array(last, type=pa.int32()), pa.array(length)),
        "n": np.append(np.diff(ends), 0),
    })


def _wave(found: pa.Table, asked: pa.Table, k: int, avg_length: float, first: bool) -> pa.Table:
    """One segment and one block of queries: the best k items per query among the blocks that are looked at. `asked` has rows with a term and
    its weight, and in the second wave rows with a block to look at. In the first these are the blocks with the highest bounds that surely
    hold k items; there are rows as well with the other blocks that may matter, and one with the postings looked at (n) and held."""
    out: dict[str, list] = {name: [] for name in ("query", "item", "bm25", "place", "block", "bound", "n", "held")}

    def tell(query: int, size: int, **columns) -> None:
        for name, parts in out.items():
            parts.append(pa.array(np.full(size, query)) if name == "query" else pa.array(columns[name]) if name in columns else pa.nulls(size))

    query, query_ids = _coded(asked.column("query_id"))
    empty = pc.equal(found.column("term"), "")
    own, found = found.filter(empty), found.filter(pc.invert(empty))
    item, ids = _coded(own.column("ids").combine_chunks().flatten())
    _, lengths = _flat(own.column("lengths"))
    _, doc = _flat(found.column("docs"))
    _, tf = _flat(found.column("tf"))
    entries, block = _flat(found.column("blocks"))
    count, top = _flat(found.column("counts"))[1].astype(np.int64), _flat(found.column("tops"))[1]
    postings = np.append(0, np.cumsum(count))  # where each block of a row begins
    value, n_blocks = impact(tf, lengths[doc], avg_length), int(block.max(initial=-1)) + 1
    row = np.asarray(pc.fill_null(pc.index_in(asked.column("term").combine_chunks(), found.column("term").combine_chunks(), skip_nulls=True), -1))
    idf = asked.column("idf").to_numpy()
    given = asked.column("block").to_numpy()
    weights = np.flatnonzero(row >= 0)
    weights = weights[np.argsort(query[weights], kind="stable")]
    looks = np.flatnonzero(asked.column("block").is_valid().to_numpy())
    for part in np.split(weights, _new(query[weights])[1:]) if len(weights) else []:
        q, r = query[part[0]], row[part]
        at = _ranges(entries[r], entries[r + 1])
        weight, b = np.repeat(idf[part], entries[r + 1] - entries[r]), block[at]
        look = np.zeros(n_blocks, dtype=bool)
        if first:
            bound, n = np.bincount(b, weight * top[at], n_blocks), np.bincount(b, count[at], n_blocks).astype(np.int64)
            least = np.zeros(n_blocks, dtype=np.int64)
            np.maximum.at(least, b, count[at])
            held = np.flatnonzero(n)
            held = held[np.argsort(-bound[held], kind="stable")]
            look[held[np.cumsum(least[held]) - least[held] < k]] = True
        else:
            look[given[looks[query[looks] == q]].astype(np.int64)] = True
        at, weight = at[look[b]], weight[look[b]]
        p = _ranges(postings[at], postings[at + 1])
        score = np.bincount(item[doc[p]], np.repeat(weight, count[at]) * value[p], len(ids))
        hits = np.flatnonzero(score)
        place = np.floor(score[hits] * 1e9 + 0.5)
        best = np.lexsort((hits, -place))[:k]
        hits = hits[best]
        tell(q, len(hits), item=hits, bm25=score[hits], place=place[best])
        if first:
            floor = score[hits[-1]] if len(hits) == k else -math.inf
            rest = held[~look[held] & (bound[held] >= floor - MARGIN)]
            tell(q, len(rest), block=rest, bound=bound[rest], n=n[rest])
            tell(q, 1, n=[n[look].sum()], held=[n.sum()])
    kinds = {"query": pa.int64(), "item": pa.int64(), "bm25": pa.float64(), "place": pa.float64(), "block": pa.int32(), "bound": pa.float64(), "n": pa.int64(), "held": pa.int64()}
    column = {name: pa.chunked_array([x.cast(kinds[name]) for x in parts], type=kinds[name]).combine_chunks() for name, parts in out.items()}
    return pa.table({"query_id": query_ids.take(column.pop("query")), "id": ids.take(column.pop("item")), **column})


class LexicalIndex:
    """Postings in `path`, with the size of the corpus, its mean length and the number of segments."""

    ROWS = "term string, segment int, docs array<int>, tf array<int>, blocks array<int>, counts array<int>, tops array<double>, ids array<long>, lengths array<long>, n long"
    SCHEMA = ROWS + ", bucket int"

    def __init__(self, spark: SparkSession, path: str, n: int, avg_length: float, segments: int) -> None:
        self.spark, self.path, self.n, self.avg_length, self.segments = spark, path, n, avg_length, segments

    @classmethod
    def build(cls, items: DataFrame, path: str | None = None, block_items: int = BLOCK_ITEMS) -> LexicalIndex:
        """Index the visible items by the words of title and text."""
        spark = items.sparkSession
        lists = word_lists(items)
        lists.write.option("compression", COMPRESSION).parquet(kept := scratch_path(spark, "word-lists"))
        counted = spark.read.schema(lists.schema).parquet(kept)
        # texts without a word count for the corpus as well
        sizes = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), F.sum(F.size("tf")).alias("postings")).first()
        segments = max(1, math.ceil((sizes.postings or 0) / SEGMENT_POSTINGS), math.ceil(sizes.n / SEGMENT_ITEMS))
        index = cls(spark, path or scratch_path(spark, "lexical"), sizes.n, sizes.mean or 1.0, segments)
        avg_length = index.avg_length
        dealt = counted.filter("length > 0").withColumn("segment", F.pmod(F.xxhash64("id"), F.lit(segments)).cast("int"))
        rows = dealt.repartition(segments, "segment").groupBy("segment").applyInArrow(lambda t: _posting_rows(t, block_items, avg_length), cls.ROWS)
        bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
        sorted_rows = rows.withColumn("bucket", bucket).sortWithinPartitions("bucket", "term", "segment")
        sorted_rows.write.option("compression", COMPRESSION).partitionBy("bucket").mode("overwrite").parquet(index.path)
        discard(spark, kept)
        return index

    def rows(self, terms: DataFrame) -> DataFrame:
        """The posting rows of `terms(term)`; buckets without a wanted term are not read."""
        bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
        wanted = [r.b for r in terms.select(bucket.alias("b")).distinct().collect()]  # at most BUCKETS numbers
        return self.spark.read.schema(self.SCHEMA).parquet(self.path).filter(F.col("bucket").isin(wanted)).drop("bucket")

    def search(self, queries: DataFrame, k: int = K.POOL) -> tuple[DataFrame, DataFrame]:
        """(query_id, id, bm25, rank) of the best k items per query, and (query_id, read, all): postings scored and held."""
        named = queries.filter(F.col("query_id").isNotNull())
        terms = materialize(named.select("query_id", F.explode(search_terms(F.col("query"))).alias("term")), "terms")
        wanted = materialize(terms.select("term").union(self.spark.createDataFrame([("",)], "term string")).distinct(), "wanted-terms")
        found = materialize(self.rows(wanted).join(wanted, "term", "left_semi"), "found-postings")
        df = found.filter("term <> ''").groupBy("term").agg(F.sum("n").alias("df"))
        idf = F.log(1 + (F.lit(self.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        q_blocks = max(1, math.ceil(terms.select("query_id").distinct().count() / SCORED_QUERIES))
        qb = F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int")
        weights = materialize(terms.join(df, "term").select("query_id", "term", idf.alias("idf"), qb.alias("qb")), "weights")
        # the first wave: blocks of each segment by their bounds until they surely hold k items
        everywhere = F.explode(F.sequence(F.lit(0), F.lit(self.segments - 1)))
        one = materialize(self._scored(found, weights.withColumn("segment", everywhere).withColumn("block", F.lit(None).cast("int")), q_blocks, k, True), "first-wave")
        best = Window.partitionBy("query_id").orderBy(F.desc("place"), "id")
        hits = one.filter("place IS NOT NULL").select("query_id", "id", "bm25", "place")
        floor = hits.withColumn("rank", F.row_number().over(best) - 1).filter(F.col("rank") == k - 1).select("query_id", F.col("bm25").alias("floor"))
        rest = one.filter("block IS NOT NULL").join(floor, "query_id", "left").filter(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - MARGIN))
        rest = materialize(rest.select("query_id", qb.alias("qb"), "segment", "block", "n"), "second-blocks")
        again = weights.join(rest.select("qb", "segment").distinct(), "qb").withColumn("block", F.lit(None).cast("int"))
        two = self._scored(found, again.unionByName(rest.drop("n"), allowMissingColumns=True), q_blocks, k, False)
        both = hits.unionByName(two.select("query_id", "id", "bm25", "place"))
        ranked = both.withColumn("rank", F.row_number().over(best) - 1).filter(F.col("rank") < k).drop("place")
        looked = one.filter("held IS NOT NULL").select("query_id", "n", "held").unionByName(rest.select("query_id", "n"), allowMissingColumns=True)
        work = looked.groupBy("query_id").agg(F.sum("n").alias("read"), F.sum("held").alias("all"))
        return ranked, work

    def _scored(self, found: DataFrame, asked: DataFrame, q_blocks: int, k: int, first: bool) -> DataFrame:
        """What `_wave` returns for all segments and blocks of queries."""
        avg_length, kind = self.avg_length, asked.schema["query_id"].dataType.simpleString()
        left = found.drop("n").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

        def wave(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
            t = _wave(rows, queries, k, avg_length, first)
            return t.append_column("segment", pa.repeat(pa.scalar(key[0].as_py(), pa.int32()), len(t)))

        schema = f"query_id {kind}, id long, bm25 double, place double, block int, bound double, n long, held long, segment int"
        return left.groupBy("segment", "qb").cogroup(asked.groupBy("segment", "qb")).applyInArrow(wave, schema)
