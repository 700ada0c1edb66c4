"""Registered queries: vectors, clusters, search, answer context and knowledge tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom import constants as K
from storyloom.functions import scores as S
from storyloom.functions import urls as U
from storyloom.operators import dedup, knowledge, neighbours, reactions, retrieval
from storyloom.operators.lexical_index import LexicalIndex
from storyloom.plans import tables as T
from storyloom.plans.registry import AS_OF, query

c = F.col
SIMILAR = 0.35  # the test vectors are nearly orthogonal: no pair reaches the production threshold
SEARCH_MIN = 0.2

_NEAR_SQL = f"""
  SELECT id, neighbour_id, cos, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cos DESC, neighbour_id) AS rank FROM (
    SELECT a.id, b.id AS neighbour_id, list_cosine_similarity(a.vec, b.vec) AS cos FROM vecs a, vecs b WHERE a.id <> b.id) WHERE cos >= {SIMILAR}) WHERE rank <= 5"""


@query("d2_semantic_neighbours", f"SELECT id, neighbour_id, round(cos, 6) AS cos, rank FROM ({_NEAR_SQL})")
def d2(spark, d):
    return neighbours.neighbours(T.vectors(spark, d), SIMILAR).withColumn("cos", F.round("cos", 6))


@query(
    "d3_merged_clusters",
    f"""WITH RECURSIVE base AS (SELECT id, min(id) OVER (PARTITION BY CASE WHEN url IS NULL THEN id::VARCHAR WHEN url LIKE 'https://github%' THEN url ELSE text_digest END) AS cid FROM items),
        links AS (SELECT DISTINCT a.cid AS u, b.cid AS v FROM ({_NEAR_SQL}) n JOIN base a ON a.id = n.id JOIN base b ON b.id = n.neighbour_id WHERE a.cid <> b.cid),
        edges AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
        reach AS (SELECT u AS a, u AS b FROM edges UNION SELECT r.a, e.v FROM reach r JOIN edges e ON e.u = r.b),
        comp AS (SELECT a AS cid, min(b) AS root FROM reach GROUP BY a)
        SELECT id, coalesce(root, base.cid) AS cluster_id, count(*) OVER (PARTITION BY coalesce(root, base.cid)) AS size FROM base LEFT JOIN comp ON comp.cid = base.cid""",
)
def d3(spark, d):
    assigned = dedup.assign_by(T.items(spark, d), U.normalize_url(c("url")))
    return dedup.merge_clusters(assigned, neighbours.neighbours(T.vectors(spark, d), SIMILAR))


@query(
    "g11_cosine",
    "SELECT id, round(coalesce(list_cosine_similarity(vec, p), 0), 6) AS cos FROM items LEFT JOIN vecs USING (id), (SELECT vec AS p FROM profile_vecs WHERE vertical = 'it')",
)
def g11(spark, d):
    ref = T.profile_vectors(spark, d).filter("vertical = 'it'").select("vec").scalar()
    i = T.items(spark, d, vectors=True).select("id", "vec").withColumn("ref", ref)
    return i.select("id", F.round(S.cosine(c("vec"), c("ref")), 6).alias("cos"))


@query(
    "g12_vector_top_k",
    f"""SELECT query_id, id, round(cos, 6) AS cos, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, id) - 1 AS rank FROM (
          SELECT r.query_id, v.id, list_cosine_similarity(r.query_vec, v.vec) AS cos FROM requests r, vecs v WHERE r.query_id <> v.id) WHERE cos >= {SEARCH_MIN}) WHERE rank < 10""",
)
def g12(spark, d):
    hits = neighbours.search(T.queries_table(spark, d), T.vectors(spark, d), 10, SEARCH_MIN, exclude_self=True)
    return hits.withColumn("cos", F.round("cos", 6))


@query("g13_candidate_pool", "SELECT query_id, id, pos FROM hit_pool WHERE pos <= 160")
def g13(spark, d):
    q = T.queries_table(spark, d)
    sem = retrieval.semantic(q, T.vectors(spark, d), min_cos=SEARCH_MIN)
    return retrieval.candidate_pool(sem, retrieval.lexical(q, T.items(spark, d))).select("query_id", "id", "pos")


@query(
    "h1_search_terms",
    """SELECT query_id, nullif(array_to_string(list_filter(kept, lambda w, i: list_position(kept, w) = i), ' '), '') AS terms FROM (
         SELECT query_id, list_filter(words, lambda w: w NOT IN ({stop}) AND w NOT IN ({fresh})) AS kept FROM request_words)""".format(
        stop=", ".join(f"'{w}'" for w in K.STOP_WORDS), fresh=", ".join(f"'{w}'" for w in K.FRESH_WORDS)
    ),
)
def h1(spark, d):
    return T.queries_table(spark, d).select("query_id", F.array_join(retrieval.search_terms(c("query")), " ").alias("terms"))


@query(
    "h2_intents",
    "SELECT query_id, list_has_any(words, [{f}]) AS fresh, list_has_any(words, [{p}]) AS project FROM request_words".format(
        f=", ".join(f"'{w}'" for w in K.FRESH_WORDS), p=", ".join(f"'{w}'" for w in K.PROJECT_WORDS)
    ),
)
def h2(spark, d):
    return T.queries_table(spark, d).select(
        "query_id", retrieval.wants_fresh(c("query")).alias("fresh"), retrieval.wants_projects(c("query")).alias("project")
    )


@query("h3_lexical", "SELECT query_id, id, round(bm25, 6) AS bm25, rank FROM lex_hits")
def h3(spark, d):
    return retrieval.lexical(T.queries_table(spark, d), T.items(spark, d)).withColumn("bm25", F.round("bm25", 6))


def _indexed(spark, d):
    return LexicalIndex.build(T.items(spark, d), block_items=64).search(T.queries_table(spark, d))


@query("h3_stored_index", "SELECT query_id, id, round(bm25, 6) AS bm25, rank FROM lex_hits")
def h3_index(spark, d):
    return _indexed(spark, d)[0].withColumn("bm25", F.round("bm25", 6))


@query("h4_semantic", "SELECT query_id, id, round(cos, 6) AS cos, rank FROM sem_hits")
def h4(spark, d):
    return retrieval.semantic(T.queries_table(spark, d), T.vectors(spark, d), min_cos=SEARCH_MIN).withColumn("cos", F.round("cos", 6))


@query(
    "h5_rank_fusion",
    """SELECT query_id, id, round(sum(1 / (60 + rank)::DOUBLE), 9) AS rrf FROM (SELECT query_id, id, rank FROM sem_hits UNION ALL SELECT query_id, id, rank FROM lex_hits) GROUP BY 1, 2""",
)
def h5(spark, d):
    q = T.queries_table(spark, d)
    sem = retrieval.semantic(q, T.vectors(spark, d), min_cos=SEARCH_MIN)
    lists = retrieval.as_list(sem, 0).unionByName(retrieval.as_list(retrieval.lexical(q, T.items(spark, d)), 1))
    return retrieval.fuse(lists).select("query_id", "id", F.round("rrf", 9).alias("rrf"))


def _hybrid(spark, d):
    return retrieval.hybrid(
        T.queries_table(spark, d), T.items(spark, d, clusters=True), T.vectors(spark, d), T.as_of(), min_cos=SEARCH_MIN
    )


@query("h6_hybrid_search", "SELECT query_id, id, rank, round(rrf, 9) AS rrf FROM hybrid_hits")
def h6(spark, d):
    return _hybrid(spark, d).select("query_id", "id", "rank", F.round("rrf", 9).alias("rrf"))


@query(
    "h6_saved_search",
    f"""SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, first_seen) AS rank FROM (
         SELECT h.*, row_number() OVER (PARTITION BY h.query_id, f.cluster_id IS NULL, coalesce(f.cluster_id, f.id) ORDER BY round(h.rrf, 12) DESC, h.first_seen) AS c
         FROM (SELECT query_id, id, sum(1 / (60 + rank)::DOUBLE) AS rrf, min((list_no, rank)) AS first_seen FROM (
           SELECT query_id, id, rank, 0 AS list_no FROM sem_hits UNION ALL SELECT query_id, id, rank, 1 FROM lex_hits
           UNION ALL SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY sort_ts DESC, pos) - 1, 2 FROM f WHERE wants_fresh
           UNION ALL SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1, 3 FROM f WHERE wants_project AND (starts_with(feed_name, 'gh_') OR coalesce(contains(url, 'github.com'), false))
         ) GROUP BY 1, 2) h JOIN f ON f.query_id = h.query_id AND f.id = h.id) WHERE c = 1""".replace(
        "SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round", "WITH f AS (SELECT * FROM hit_facts WHERE vertical = 'it' AND sort_ts > "
        + AS_OF + " - INTERVAL 700 HOUR AND id IN (SELECT item_id FROM marks WHERE signal IN ('up', 'save'))) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round", 1
    ),
)
def h6_saved(spark, d):
    marks = reactions.current_marks(T.feedback_events(spark, d)).filter(c("signal").isin(*reactions.LIKES))
    hits = retrieval.hybrid(
        T.queries_table(spark, d), T.items(spark, d, clusters=True), T.vectors(spark, d), T.as_of(), kind="it", hours=700,
        saved=marks, limit=1000, min_cos=SEARCH_MIN,
    )
    return hits.select("query_id", "id", "rank")


@query(
    "h7_reranked",
    """SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n > 1 THEN p END NULLS LAST, rank) AS new_rank FROM (
         SELECT h.*, count(*) OVER (PARTITION BY query_id) AS n, CASE rank - 1 WHEN query_id % 7 THEN 0 WHEN 9 THEN 1 WHEN 3 THEN 3 END AS p FROM hybrid_hits h)""",
)
def h7(spark, d):
    # a model's answer: some good positions, one repeated, one out of range
    orders = T.queries_table(spark, d).select(
        "query_id", F.array((c("query_id") % 7).cast("int"), F.lit(9), F.lit(99), F.lit(3), F.lit(9)).alias("picks")
    )
    return retrieval.reranked(_hybrid(spark, d), orders).select("query_id", "id", "new_rank")


@query(
    "h8_answer_context",
    f"""SELECT query_id, pos, id, line, pos <= 8 AS is_source FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY published_at DESC NULLS LAST, id) AS pos,
          '[' || coalesce(strftime(published_at, '%Y-%m-%d'), '—') || '] ' || coalesce(title, 'None') || ' — ' ||
          replace(substring(coalesce(nullif(summary, ''), nullif(trim(regexp_replace(text, '\\s+', ' ', 'g')), ''), ''), 1, 280), chr(10), ' ') ||
          ' (' || CASE WHEN starts_with(feed_name, 'tw_') THEN '@' || substring(feed_name, 4) ELSE feed_name END || ')' AS line
        FROM (SELECT * FROM (SELECT r.query_id, v.id, row_number() OVER (PARTITION BY r.query_id ORDER BY list_cosine_similarity(r.query_vec, v.vec) DESC, v.id) AS k
            FROM requests r, vecs v WHERE list_cosine_similarity(r.query_vec, v.vec) >= 0.1) WHERE k <= 43) h JOIN items i USING (id) WHERE processed_at IS NOT NULL) WHERE pos <= 28""",
)
def h8(spark, d):
    return retrieval.answer_context(T.queries_table(spark, d), T.items(spark, d), T.vectors(spark, d), min_cos=0.1)


# --- knowledge ----------------------------------------------------------------------------------------------------------


def _extracted(spark, d):
    """What a model would extract: the item's tags as concepts, its feed and language as entities."""
    i = T.items(spark, d).filter("processed_at is not null and skip_reason is null")
    note = F.coalesce("title", F.lit(""))

    def named(names):
        return F.transform(names, lambda n: F.struct(n.alias("name"), note.alias("note")))

    return i.select(
        knowledge.source_ref().alias("source_ref"),
        F.date_format("processed_at", "yyyy-MM-dd").alias("date"),
        c("id").alias("seq"),
        named(c("tags")).alias("concepts"),
        named(F.array("feed_name", "lang")).alias("entities"),
    )


def _mentions(spark, d):
    return knowledge.mentions(_extracted(spark, d))


@query("h9_wiki_mentions", "SELECT kind, slug, source_ref, name, date, note FROM mention_rows")
def h9(spark, d):
    # merging the same sources twice adds nothing
    m = _mentions(spark, d)
    return knowledge.merge_mentions(m, _mentions(spark, d)).select("kind", "slug", "source_ref", "name", "date", "note")


@query("h9_wiki_pages", "SELECT kind, slug, title, note, mentions FROM wiki_pages")
def h9_pages(spark, d):
    return knowledge.pages(_mentions(spark, d))


@query(
    "h10_source_pages",
    """SELECT id, 'sources/' || id::VARCHAR || '-' || coalesce(nullif(trim(substring(trim(regexp_replace(lower(trim(coalesce(nullif(title, ''), 'source'))), '[^0-9a-zA-Zа-яёА-ЯЁ]+', '-', 'g'), '-'), 1, 60), '-'), ''), 'untitled') AS source_ref,
         coalesce(nullif(title, ''), '(без заголовка)') AS title, feed_name AS feed, array_to_string(list_transform(tags[1:6], lambda t: '#' || t), ' ') AS tags, coalesce(url, '') AS url,
         trim(coalesce(nullif(summary, ''), nullif(trim(regexp_replace(text, '\\s+', ' ', 'g')), ''), '')) AS body FROM items""",
)
def h10(spark, d):
    return knowledge.source_pages(T.items(spark, d))


def _sources(spark, d):
    saved = T.items(spark, d).filter("processed_at is not null and skip_reason is null")
    return knowledge.source_bodies(saved, F.date_format("processed_at", "yyyy-MM-dd"))


def _all_pages(spark, d):
    return knowledge.pages(_mentions(spark, d)).unionByName(_sources(spark, d).drop("piece"))


def _all_lines(spark, d):
    return knowledge.page_lines(_mentions(spark, d)).unionByName(_sources(spark, d).select("kind", "slug", "piece"))


@query("h11_wiki_lint", "SELECT kind, count(*) AS pages, count(*) FILTER (WHERE mentions <= 1 AND kind <> 'sources') AS weak FROM wiki_all_pages GROUP BY kind")
def h11(spark, d):
    return knowledge.lint(_all_pages(spark, d))


@query(
    "h12_wiki_listing",
    "SELECT kind, slug, mentions, row_number() OVER (PARTITION BY kind ORDER BY mentions DESC, lower(title), slug) AS rank FROM wiki_all_pages",
)
def h12(spark, d):
    return knowledge.listing(_all_pages(spark, d)).select("kind", "slug", "mentions", "rank")


_FIND_SQL = f"""
  SELECT query_id, kind, slug, score, rank, sum(size) OVER (PARTITION BY query_id ORDER BY rank) <= {K.WIKI_MAX_CONTEXT} AS in_context FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kind, slug) AS rank FROM (
      SELECT query_id, kind, slug, any_value(size) AS size, sum(hits)::BIGINT + CASE WHEN bool_or(in_slug) THEN 3 ELSE 0 END AS score FROM (
        SELECT w.query_id, b.kind, b.slug, len(b.body) + len(b.kind) + len(b.slug) + 12 AS size,
          (len(b.body) - len(replace(lower(b.body), w.word, ''))) // len(w.word) AS hits, contains(lower(b.slug), w.word) AS in_slug
        FROM (SELECT DISTINCT query_id, unnest(list_transform(regexp_extract_all(query, '[0-9a-zA-Zа-яёА-ЯЁ]{{3,}}'), lambda x: lower(x))) AS word FROM requests) w, wiki_all_bodies b)
      GROUP BY query_id, kind, slug) WHERE score > 0) WHERE rank <= 8"""


@query("h13_wiki_search", f"SELECT query_id, kind, slug, score, rank FROM ({_FIND_SQL})")
def h13(spark, d):
    return knowledge.find_pages(T.queries_table(spark, d), _all_lines(spark, d)).select("query_id", "kind", "slug", "score", "rank")


@query("f7_budgeted_context", f"SELECT query_id, kind, slug, in_context FROM ({_FIND_SQL})")
def f7(spark, d):
    return knowledge.find_pages(T.queries_table(spark, d), _all_lines(spark, d)).select("query_id", "kind", "slug", "in_context")


@query("f9_retrieval_rank", "SELECT query_id, id, rank, 0 AS list_no FROM sem_hits UNION ALL SELECT query_id, id, rank, 1 FROM lex_hits")
def f9(spark, d):
    q = T.queries_table(spark, d)
    sem = retrieval.semantic(q, T.vectors(spark, d), min_cos=SEARCH_MIN)
    return retrieval.as_list(sem, 0).unionByName(retrieval.as_list(retrieval.lexical(q, T.items(spark, d)), 1))
