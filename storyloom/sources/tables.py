"""Item tables: schemas, idempotent upsert, cursors, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom import constants as K
from storyloom.functions.urls import normalize_url

# --- fixed values: item record, and what a second arrival of the same key overwrites ---------------------------
ITEM_SCHEMA = (
    "source_type string, source_id string, url string, title string, text string, media array<string>, "
    "author string, feed_name string, raw_score double, category string, published_at timestamp"
)
KEY = ["source_type", "source_id"]
OVERWRITTEN = [
    "url", "url_normalized", "title", "text", "media", "author", "feed_name", "raw_score", "category", "published_at",
]
MAX_LENGTHS = {"source_type": 32, "source_id": 255, "author": 255, "feed_name": 64, "category": 64}


def prepared(batch: DataFrame) -> DataFrame:
    """Arrivals with the canonical URL and with texts cut to their column sizes."""
    df = batch.withColumn("url_normalized", normalize_url(F.col("url")))
    for name, n in MAX_LENGTHS.items():
        df = df.withColumn(name, F.substring(name, 1, n))
    return df


def latest_per_key(batch: DataFrame, arrival: str = "arrival") -> DataFrame:
    """The last arrival of each key. Only the leading row per key leaves a map task, so a key that repeats endlessly
    stays cheap."""
    newest = Window.partitionBy(*KEY).orderBy(F.desc(arrival))
    return batch.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn")


def upsert(target: DataFrame, batch: DataFrame, as_of: Column, arrival: str = "arrival") -> DataFrame:
    """`target` after merging `batch` by (source_type, source_id): the ten source columns are overwritten, everything
    else is preserved. Adds `was_new`, and `touched` for keys in the batch. New rows get `fetched_at = as_of`, which may be an expression
    of the batch's columns, and a repeatable id from their key."""
    new = latest_per_key(prepared(batch), arrival)
    t = target.withColumn("_old", F.lit(True))
    n = new.select(*[F.col(k) for k in KEY], F.lit(True).alias("_new"), as_of.alias("_as_of"), *[F.col(c).alias(f"n_{c}") for c in OVERWRITTEN])
    j = t.join(n, KEY, "full_outer")
    fresh, hit = F.col("_old").isNull(), F.col("_new").isNotNull()
    out = []
    for c in target.columns:
        if c in KEY:
            out.append(F.col(c))
        elif c in OVERWRITTEN:
            out.append(F.when(hit, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c))
        elif c == "id":
            out.append(F.when(fresh, F.xxhash64(*KEY)).otherwise(F.col("id")).alias("id"))
        elif c == "fetched_at":
            out.append(F.when(fresh, F.col("_as_of")).otherwise(F.col(c)).alias(c))
        elif c == "attempts":
            out.append(F.when(fresh, F.lit(0)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out, fresh.alias("was_new"), hit.alias("touched"))


def latest_cursors(runs: DataFrame) -> DataFrame:
    """Current state per source from the log of runs: the last run decides cursor and error."""
    return runs.groupBy("source_name").agg(
        F.max("last_run_at").alias("last_run_at"),
        F.max_by("cursor", "last_run_at").alias("cursor"),
        F.max_by(F.coalesce("last_error", F.lit("")), "last_run_at").alias("last_error"),
    )


def retained(log: DataFrame, as_of: Column, days: int = K.RETENTION_DAYS, ts: str = "ts") -> DataFrame:
    return log.filter(F.col(ts) > as_of - F.expr(f"INTERVAL {int(days)} DAYS"))
