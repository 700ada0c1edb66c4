"""Search over the item table for a table of queries: lexical, semantic, fused, re-ranked; and context for answers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom import constants as K
from storyloom.functions import lit_strings
from storyloom.functions.text import seconds_between, strip_html, tokens
from storyloom.operators import neighbours as N
from storyloom.operators.feeds import VISIBLE, collapse, kind_filter, since_hours
from storyloom.session import materialize, spread

BM25_K1, BM25_B = 1.2, 0.75
# items and queries of the blocks that are scored together, and items of a block whose terms are a matrix at a time
SCORED_BLOCK, SCORED_QUERIES, SCORED_ITEMS = 8192, 512, 256


def _query_words(query: Column) -> Column:
    words = F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit("([0-9a-zA-Zа-яёА-ЯЁ]{2,})"), F.lit(1))
    return F.transform(words, lambda w: F.lower(w))


def search_terms(query: Column) -> Column:
    """Distinct words to look for, in order; NULL when only stop and freshness words are there."""
    terms = F.array_distinct(
        F.filter(_query_words(query), lambda w: ~w.isin(*K.STOP_WORDS) & ~w.isin(*K.FRESH_WORDS))
    )
    return F.when(F.size(terms) > 0, terms)


def wants_fresh(query: Column) -> Column:
    return F.arrays_overlap(_query_words(query), lit_strings(K.FRESH_WORDS))


def wants_projects(query: Column) -> Column:
    return F.arrays_overlap(_query_words(query), lit_strings(K.PROJECT_WORDS))


COUNTED_WORDS = 1 << 18  # words that are counted at a time, about


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with a list column `words`, cut into runs of rows of a bounded number of words."""
    for b in batches:
        bounds = np.asarray(b.column("words").offsets, dtype=np.int64)
        cuts = np.flatnonzero(np.diff((bounds[:-1] - bounds[0]) // COUNTED_WORDS)) + 1
        for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
            yield b.slice(start, stop - start)


def _distinct(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """The number of words of each list; and for each distinct word of a list, in order of the lists: the list, the word, how often it is there."""
    bounds = np.asarray(lists.offsets, dtype=np.int64)
    words = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    n = np.diff(bounds)
    width = max(1, len(words.dictionary))
    keys, tf = np.unique(np.repeat(np.arange(len(n)), n) * width + np.asarray(words.indices, dtype=np.int64), return_counts=True)
    return n, keys // width, words.dictionary.take(pa.array(keys % width)), tf


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, length, term, tf) of the rows (id, words), whose last word is the empty one: distinct words of each row with their numbers."""
    yield from map(_counted_run, _runs(batches))


def _counted_run(b: pa.RecordBatch) -> pa.RecordBatch:
    n, row, term, tf = _distinct(b.column("words"))
    return pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row)), pa.array(n[row] - 1), term, pa.array(tf)], names=["id", "length", "term", "tf"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, length, terms, tf) of the rows (id, words): one row each, its distinct words in one text with blanks between, and their numbers."""
    for b in _runs(batches):
        n, row, term, tf = _distinct(b.column("words"))
        bounds = pa.array(np.searchsorted(row, np.arange(len(n) + 1)), type=pa.int32())
        terms = pc.binary_join(pa.ListArray.from_arrays(bounds, term), " ")
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), pa.array(n), terms, pa.ListArray.from_arrays(bounds, pa.array(tf, type=pa.int32()))], names=["id", "length", "terms", "tf"])


def _title_and_text() -> Column:
    return tokens(F.concat_ws(" ", "title", "text"))


def _visible(items: DataFrame) -> DataFrame:
    return spread(items.filter(VISIBLE).select("id", "title", "text"))


def word_counts(items: DataFrame) -> DataFrame:
    """(id, length, term, tf) of the visible items' titles and texts. Words are counted inside each row, without a shuffle; every item
    also has one row with an empty term, which carries its length."""
    docs = _visible(items).select("id", F.array_append(_title_and_text(), F.lit("")).alias("words"))
    return docs.mapInArrow(_counted, "id long, length long, term string, tf long")


def word_lists(items: DataFrame) -> DataFrame:
    """(id, length, terms, tf), a row per visible item: what `word_counts` has in a row per word. `terms` are the
    distinct words with blanks between, which no word holds."""
    return _visible(items).select("id", _title_and_text().alias("words")).mapInArrow(_listed, "id long, length long, terms string, tf array<int>")


def impact(tf: np.ndarray, length: np.ndarray, avg_length: float) -> np.ndarray:
    """What a term that is there `tf` times adds to an item's score, before its inverse document frequency."""
    tf = tf.astype(np.float64)
    return tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / avg_length))


def _coded(col) -> tuple[np.ndarray, pa.Array]:
    """A number for each value of a column, in order of the values (NULL first), and the values by number."""
    coded = (col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(coded.dictionary, null_placement="at_start")
    place = np.empty(len(order), dtype=np.int64)
    place[np.asarray(order)] = np.arange(len(order))
    return place[np.asarray(coded.indices, dtype=np.int64)], coded.dictionary.take(order)


def _scores(postings: pa.Table, weights: pa.Table, k: int) -> pa.Table:
    """(query_id, id, bm25, place) of the best k items per query of one block of items and one of queries. A few items at a time are a
    matrix of what their terms add, times the matrix of the queries' weights. `place` is the score as it is compared."""
    query, query_ids = _coded(weights.column("query_id"))
    item, ids = _coded(postings.column("id"))
    term, terms = _coded(weights.column("term"))
    wanted = np.zeros((len(terms), len(query_ids)))
    np.add.at(wanted, (term, query), weights.column("idf").to_numpy())
    avg_length = weights.column("avg_length").to_numpy()[0] if len(weights) else 1.0
    value = impact(postings.column("tf").to_numpy(), postings.column("length").to_numpy(), avg_length)
    at = np.asarray(pc.fill_null(pc.index_in(postings.column("term").combine_chunks(), terms), -1), dtype=np.int64)
    order = np.argsort(item, kind="stable")
    order = order[at[order] >= 0]
    item, at, value = item[order], at[order], value[order]
    # the best so far per query: one row each of (item, score, place), unfilled places below all scores
    found = [[np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.float64, np.float64)]]
    for start in range(0, len(ids), SCORED_ITEMS):
        run = slice(*np.searchsorted(item, [start, start + SCORED_ITEMS]))
        adds = np.zeros((min(SCORED_ITEMS, len(ids) - start), len(terms)))
        np.add.at(adds, (item[run] - start, at[run]), value[run])
        score = (adds @ wanted).T
        place = np.floor(score * 1e9 + 0.5)
        r, c = np.nonzero(score > 0)
        found.append([r, c + start, score[r, c], place[r, c]])
        r, c, score, place = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((c, -place, r))
        r, c, score, place = r[order], c[order], score[order], place[order]
        kept = np.arange(len(r)) - np.searchsorted(r, r) < k
        found = [[r[kept], c[kept], score[kept], place[kept]]]
    r, c, score, place = found[0]
    return pa.table({"query_id": query_ids.take(pa.array(r)), "id": ids.take(pa.array(c)), "bm25": score, "place": place})


def lexical(queries: DataFrame, items: DataFrame, k: int = K.POOL) -> DataFrame:
    """(query_id, id, bm25, rank): visible items that hold any query term in title or text, best k per query.

    Postings are the counts of terms that some query asks for, kept as a table in the shared folder, from which document frequencies,
    corpus size and scores are read. They are dealt into blocks by a hash of the item; each block meets each block of queries and keeps the
    best k per query, so what is shuffled are postings, never pairs of item and query. BM25 stands in for cover-density ranking."""
    spark = queries.sparkSession
    terms = materialize(queries.select("query_id", F.explode(search_terms(F.col("query"))).alias("term")), "terms")
    wanted = materialize(terms.select("term").union(spark.createDataFrame([("",)], "term string")).distinct(), "wanted-terms")
    postings = materialize(word_counts(items).join(wanted, "term", "left_semi"), "postings")
    frequency = postings.groupBy("term").agg(F.count("*").alias("df"))
    corpus = postings.filter("term = ''").agg(F.struct(F.count("*").alias("n"), F.avg("length").alias("avg_length"))).scalar()
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # per query term its inverse document frequency: one row per (query, term) of the query table
    weighted = (
        terms.join(frequency, "term")
        .withColumn("corpus", corpus)
        .select("query_id", "term", "df", "corpus.n", "corpus.avg_length")
        .select("query_id", "term", weight.alias("idf"), "avg_length")
    )
    held = postings.filter("term <> ''")
    q_blocks = max(1, math.ceil(terms.select("query_id").distinct().count() / SCORED_QUERIES))
    i_blocks = max(1, math.ceil(postings.filter("term = ''").count() / SCORED_BLOCK))
    dealt = lambda df, key, own, n, other, n_other: df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn(
        other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))
    items_side = dealt(held, "id", "ib", i_blocks, "qb", q_blocks).groupBy("ib", "qb")
    queries_side = dealt(weighted, "query_id", "qb", q_blocks, "ib", i_blocks).groupBy("ib", "qb")
    kind = lambda df, name: df.schema[name].dataType.simpleString()
    scored = items_side.cogroup(queries_side).applyInArrow(
        lambda p, w: _scores(p, w, k), f"query_id {kind(queries, 'query_id')}, id {kind(held, 'id')}, bm25 double, place double")
    best = Window.partitionBy("query_id").orderBy(F.desc("place"), "id")
    return scored.withColumn("rank", F.row_number().over(best) - 1).filter(F.col("rank") < k).select("id", "query_id", "bm25", "rank")


def semantic(queries: DataFrame, vectors: DataFrame, k: int = K.POOL, min_cos: float = K.SEARCH_MIN_SIMILARITY) -> DataFrame:
    return N.search(queries, vectors, k, min_cos)


def as_list(ranked: DataFrame, list_no: int) -> DataFrame:
    return ranked.select("query_id", "id", "rank", F.lit(list_no).alias("list_no"))


def fuse(lists: DataFrame, k: int = K.RRF_K) -> DataFrame:
    """(query_id, id, rrf, list_no, rank): reciprocal rank fusion of `lists(query_id, list_no, id, rank)`; ties go to
    what appeared first."""
    return lists.groupBy("query_id", "id").agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("rrf"), F.min(F.struct("list_no", "rank")).alias("first_seen")
    )


def fused_order() -> list[Column]:
    return [F.desc(F.round("rrf", 12)), F.col("first_seen")]


def candidate_pool(sem: DataFrame, lex: DataFrame, limit: int = 2 * K.POOL) -> DataFrame:
    """(query_id, id, pos, sem_rank, lex_rank): semantic then lexical hits, each item once in order of first appearance."""
    both = as_list(sem, 0).unionByName(as_list(lex, 1))
    first = both.groupBy("query_id", "id").agg(
        F.min(F.struct("list_no", "rank")).alias("first_seen"),
        F.max(F.when(F.col("list_no") == 0, F.col("rank"))).alias("sem_rank"),
        F.max(F.when(F.col("list_no") == 1, F.col("rank"))).alias("lex_rank"),
    )
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy("first_seen"))
    return first.withColumn("pos", pos).filter(F.col("pos") <= limit).drop("first_seen")


def hybrid(
    queries: DataFrame, items: DataFrame, vectors: DataFrame, as_of: Column, kind: str = "all", hours: int = 0,
    saved: DataFrame | None = None, limit: int = 40, min_cos: float = K.SEARCH_MIN_SIMILARITY,
) -> DataFrame:
    """(query_id, rank, id, rrf, ...): lexical and semantic lists, plus a freshness list and a repository list where the
    query asks for them, fused; then filters, one row per cluster, best `limit` per query.

    Hit lists hold at most 80 rows per list and query, so everything after them grows with the query table only. The
    ranks in the four lists are columns of the candidate row, which makes fusion a projection."""
    sem, lex = semantic(queries, vectors, min_cos=min_cos), lexical(queries, items)
    ok = items.filter(VISIBLE).filter(kind_filter(kind))
    if hours > 0:
        ok = ok.filter(since_hours(as_of, hours))
    if saved is not None:
        ok = ok.join(saved.select(F.col("item_id").alias("id")), "id", "left_semi")
    facts = ok.select("id", "title", "url", "feed_name", "vertical", "personal_score", "sort_ts", "cluster_id")
    intents = queries.select(
        "query_id", wants_fresh(F.col("query")).alias("wants_fresh"), wants_projects(F.col("query")).alias("wants_project")
    )
    meta = candidate_pool(sem, lex).join(facts, "id").join(intents, "query_id")
    is_repo = F.coalesce(F.col("feed_name").startswith("gh_"), F.lit(False)) | F.coalesce(
        F.contains("url", F.lit("github.com")), F.lit(False)
    )
    newest = Window.partitionBy("query_id").orderBy(F.desc("sort_ts"), "pos")
    repos = Window.partitionBy("query_id", "_repo").orderBy("pos")
    meta = meta.withColumn("_repo", is_repo)
    meta = meta.withColumn("fresh_rank", F.when(F.col("wants_fresh"), F.row_number().over(newest) - 1)).withColumn(
        "project_rank", F.when(F.col("wants_project") & F.col("_repo"), F.row_number().over(repos) - 1)
    )
    ranks = ["sem_rank", "lex_rank", "fresh_rank", "project_rank"]
    rrf = sum((F.coalesce(1.0 / (K.RRF_K + F.col(r)), F.lit(0.0)) for r in ranks), F.lit(0.0))
    first = F.coalesce(*[F.when(F.col(r).isNotNull(), F.struct(F.lit(n).alias("list_no"), F.col(r).alias("rank"))) for n, r in enumerate(ranks)])
    hits = meta.withColumn("rrf", rrf).withColumn("first_seen", first)
    one = collapse(hits, fused_order(), by=("query_id",))
    ranked = one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*fused_order())))
    return (
        ranked.filter(F.col("rank") <= limit)
        .withColumn("age_s", seconds_between(F.col("sort_ts"), as_of))
        .drop("first_seen", "pos", "_repo", "wants_fresh", "wants_project", *ranks)
    )


def reranked(results: DataFrame, orders: DataFrame, pool: int = 30) -> DataFrame:
    """Results in the order a model chose: `orders(query_id, picks array<int>)` names 0-based positions in the first
    `pool` rows. Picked rows come first, the rest follow unchanged; positions out of range are ignored, and a query
    without a usable answer keeps its order."""
    picks = orders.select("query_id", F.posexplode("picks").alias("pick_pos", "index"))
    picks = picks.groupBy("query_id", "index").agg(F.min("pick_pos").alias("pick_pos"))
    size = F.count("*").over(Window.partitionBy("query_id"))
    base = results.withColumn("_n", size).withColumn("index", (F.col("rank") - 1).cast("int"))
    usable = (F.col("index") >= 0) & (F.col("index") < pool)
    joined = base.join(picks.filter(usable), ["query_id", "index"], "left")
    order = Window.partitionBy("query_id").orderBy(
        F.when(F.col("_n") > 1, F.col("pick_pos")).asc_nulls_last(), "rank"
    )
    return joined.withColumn("new_rank", F.row_number().over(order)).drop("_n", "index", "pick_pos")


def answer_context(
    queries: DataFrame, items: DataFrame, vectors: DataFrame, max_items: int = K.ASK_ITEMS, extra: int = K.ASK_EXTRA,
    min_cos: float = K.SEARCH_MIN_SIMILARITY,
) -> DataFrame:
    """(query_id, pos, id, line, is_source): processed items near each question, newest first, one text line each."""
    hits = N.search(queries, vectors, max_items + extra, min_cos).select("query_id", "id")
    facts = items.filter("processed_at is not null").select("id", "title", "summary", "text", "published_at", "feed_name", "url")
    rows = hits.join(facts, "id")
    order = Window.partitionBy("query_id").orderBy(F.col("published_at").desc_nulls_last(), "id")
    rows = rows.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= max_items)
    date = F.coalesce(F.date_format("published_at", "yyyy-MM-dd"), F.lit("—"))
    body = F.coalesce(F.nullif("summary", F.lit("")), strip_html(F.col("text")), F.lit(""))
    body = F.replace(F.substring(body, 1, 280), F.lit("\n"), F.lit(" "))
    src = F.when(F.col("feed_name").startswith("tw_"), F.concat(F.lit("@"), F.substring("feed_name", 4, 1 << 20))).otherwise(
        F.coalesce("feed_name", F.lit(""))
    )
    line = F.concat(F.lit("["), date, F.lit("] "), F.coalesce("title", F.lit("None")), F.lit(" — "), body, F.lit(" ("), src, F.lit(")"))
    return rows.select("query_id", "pos", "id", line.alias("line"), (F.col("pos") <= 8).alias("is_source"))
