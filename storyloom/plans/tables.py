"""Views over the given tables in the shape the operators work on.

`items`, `feedback_events`, `profiles` and the rest are plain projections and equi-joins of the given tables, so their
size is that of the tables. Extra columns that need a shuffle (labels, clusters, vectors) are attached only on request.
Timestamps are zone-free and mean UTC; nothing reads the wall clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom import constants as K

AS_OF_TEXT = "2024-01-31 00:00:00"


def as_of(text: str = AS_OF_TEXT) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str, labels: bool = False, clusters: bool = False, vectors: bool = False) -> DataFrame:
    """One row per document, shaped as a feed item. `clusters` adds `cluster_id` (exact copies share one), `labels`
    adds `llm_relevance`, `vectors` adds `vec`."""
    df = item_columns(table(spark, sf_dir, "documents"))
    if labels:
        lab = table(spark, sf_dir, "labels").select(
            F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("llm_relevance")
        )
        df = df.join(lab, "id", "left")
    if clusters:
        # clusters of exact copies; every 41st item has not been clustered yet
        c = df.groupBy("text_digest").agg(F.min("id").alias("first_id"))
        df = (
            df.join(c, "text_digest")
            .withColumn("cluster_id", F.when(F.col("id") % 41 != 0, F.col("first_id")))
            .drop("first_id")
        )
    if vectors:
        v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
        df = df.join(v, "id", "left")
    return df


_SLOT = "timestampadd(HOUR, cast(doc_id % 720 as int), TIMESTAMP_NTZ '2024-01-01 00:00:00')"
_FETCHED = f"timestampadd(MINUTE, 10, {_SLOT})"


def _after_fetch(minutes: str) -> str:
    return f"timestampadd(MINUTE, cast({minutes} as int), {_FETCHED})"


# one SQL expression per column keeps plan building cheap
ITEM_COLUMNS = {
    "id": "doc_id",
    "source_type": "CASE WHEN doc_id % 11 = 0 THEN 'telegram' WHEN doc_id % 31 = 5 THEN 'manual' ELSE 'rss' END",
    "source_id": "cast(doc_id as string)",
    "feed_name": """CASE doc_id % 10 WHEN 3 THEN 'tw_' || source WHEN 6 THEN 'gh_stars_' || source WHEN 9 THEN 'gh_' || source
        WHEN 8 THEN '@' || source ELSE source END""",
    "author": "cast(NULL as string)",
    "url": """CASE WHEN doc_id % 37 = 0 THEN NULL
        WHEN doc_id % 10 IN (6, 9) THEN 'https://github.com/' || source || '/repo-' || doc_id || '.git'
        ELSE 'https://www.Feeds.example.com/item/' || md5(text) || '/?utm_source=' || source || '&b=2&a=1#top' END""",
    "title": "CASE WHEN doc_id % 5 <> 0 THEN substring(substring_index(text, '\\n', 1), 1, 60) END",
    "text": "text",
    "text_digest": "md5(text)",
    "lang": "lang",
    "category": "CASE WHEN doc_id % 3 <> 0 THEN lang END",
    "raw_score": "(doc_id % 7) / 7.0D",
    "insight_score": "CASE WHEN doc_id % 13 <> 0 THEN (doc_id % 9) / 9.0D END",
    "published_at": f"CASE WHEN doc_id % 17 <> 0 THEN {_SLOT} END",
    "fetched_at": _FETCHED,
    "processed_at": f"CASE WHEN doc_id % 23 <> 0 THEN {_after_fetch('doc_id % 50')} END",
    "sort_ts": f"CASE WHEN doc_id % 17 <> 0 THEN {_SLOT} ELSE {_FETCHED} END",
    "vertical": "CASE doc_id % 4 WHEN 0 THEN 'business' WHEN 1 THEN 'it' WHEN 2 THEN 'medical' END",
    "skip_reason": f"""CASE WHEN doc_id % 58 = 0 THEN '{K.MUTE_PREFIX}t3'
        WHEN doc_id % 29 = 0 THEN 'низкая близость к профилям: 0.21 (ближе всего it)' END""",
    "personal_score": "CASE WHEN doc_id % 4 <> 3 AND doc_id % 19 <> 0 THEN ((doc_id * 37) % 101) / 101.0D END",
    "score": "((doc_id * 53) % 97) / 97.0D",
    "tags": """CASE WHEN doc_id % 13 = doc_id % 5 THEN array(source, lang, 't' || doc_id % 13)
        ELSE array(source, lang, 't' || doc_id % 13, 't' || doc_id % 5) END""",
    "watch_topics": """CASE doc_id % 8 WHEN 1 THEN array('Claude') WHEN 5 THEN array('Iran', 'Природные явления')
        ELSE cast(array() as array<string>) END""",
    "summary": "CASE WHEN doc_id % 6 <> 0 THEN substring(text, 1, 120) END",
    "embedding_model": "CASE WHEN doc_id % 16 = 0 THEN NULL WHEN doc_id % 15 = 0 THEN 'old' ELSE 'm1' END",
    "embedding_version": "CASE WHEN doc_id % 14 = 0 THEN NULL WHEN doc_id % 9 = 0 THEN 0 ELSE 1 END",
    "attempts": "CASE WHEN doc_id % 23 = 0 THEN (doc_id div 23) % 26 ELSE 0L END",
    "retry_after": f"CASE WHEN doc_id % 2 = 0 THEN {_after_fetch('30')} END",
    "pushed_at": f"CASE WHEN doc_id % 12 = 0 THEN {_after_fetch('20')} END",
    "channel_posted_at": f"CASE WHEN doc_id % 18 = 0 THEN {_after_fetch('25')} END",
    "star_posted_at": f"CASE WHEN doc_id % 33 = 0 THEN {_after_fetch('30')} END",
    "scored_profile_version": "doc_id % 3",
}


def item_columns(d: DataFrame) -> DataFrame:
    """The item projection of `documents`, for batch and streaming reads alike."""
    return d.selectExpr(*[f"{e} AS {n}" for n, e in ITEM_COLUMNS.items()])


SIGNALS = {"click": "up", "purchase": "save", "error": "down", "signup": "mute_topic", "view": "open"}


def feedback_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only log of clicks: (event_id, ts, user_id, item_id, signal, topic)."""
    return click_columns(table(spark, sf_dir, "events"))


def click_columns(e: DataFrame) -> DataFrame:
    """The reaction projection of `events`, for batch and streaming reads alike."""
    k = F.get_json_object("props", "$.k").cast("long")
    signal = F.element_at(F.create_map(*[F.lit(x) for kv in SIGNALS.items() for x in kv]), F.col("event_type"))
    return e.select(
        "event_id",
        "ts",
        "user_id",
        k.alias("item_id"),
        signal.alias("signal"),
        F.when(signal == "mute_topic", F.concat(F.lit("t"), (k % 13).cast("string"))).alias("topic"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def queries_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search requests: the benchmark texts, each with the vector of the same number; some ask for fresh items or for
    projects."""
    n = F.col("item_id") % 4
    text = F.when(n == 0, F.concat(F.lit("latest "), "text")).when(n == 1, F.concat("text", F.lit(" github tools"))).otherwise(F.col("text"))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), text.alias("query"))
    v = vectors(spark, sf_dir).select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    return q.join(v, "query_id", "left")


def declared_profiles(spark: SparkSession) -> DataFrame:
    """The interest profile a user declares: a dimension with one row per topic area and version."""
    rows = [
        ("business", 1, "Markets and companies", [("t1", "like"), ("t2", "mute")]),
        ("business", 2, "Markets  and   companies", [("t1", "love"), ("t3", "like"), ("t4", "dislike"), ("solar", "like")]),
        ("it", 1, "Engineering", [("t1", "love"), ("t5", "mute")]),
        ("it", 2, "Engineering and tools", [("t1", "love"), ("t6", "like"), ("t7", "mute"), ("t8", "meh")]),
        ("medical", 1, "Clinical research", [("t9", "mute"), ("en", "like")]),
    ]
    schema = "vertical string, version int, description string, topics array<struct<name:string,polarity:string>>"
    return spark.createDataFrame(rows, schema)


def edited_profiles(spark: SparkSession) -> DataFrame:
    """The declaration after the user edited it (not applied yet)."""
    rows = [
        ("business", "Markets and companies", [("t1", "love"), ("t3", "dislike"), ("t10", "like")]),
        ("it", "Engineering, tools", [("t1", "love"), ("t6", "like"), ("t7", "mute")]),
        ("medical", "Clinical research", [("t9", "mute"), ("en", "like")]),
    ]
    schema = "vertical string, description string, topics array<struct<name:string,polarity:string>>"
    return spark.createDataFrame(rows, schema)


def profile_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vector per topic area: the mean vector of embedding labels 0, 1 and 2."""
    e = table(spark, sf_dir, "embeddings").filter(F.col("label").isin(0, 1, 2))
    area = F.element_at(
        F.create_map(*[F.lit(x) for kv in enumerate(K.VERTICALS) for x in kv]), F.col("label")
    )
    return (
        e.select(area.alias("vertical"), F.posexplode("embedding"))
        .groupBy("vertical", "pos")
        .agg(F.avg(F.col("col").cast("double")).alias("v"))
        .groupBy("vertical")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("pv"))
        .select("vertical", F.transform("pv", lambda p: p["v"]).alias("vec"))
    )
