"""Streaming jobs over file or message sources, each run to the end of its input with `available_now`.

State that must survive is kept in checkpoints and in tables below the shared folder. A table written by `foreachBatch`
has one folder per batch id, overwritten when a batch is repeated, so every step may be retried.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from storyloom import constants as K
from storyloom.operators import dedup, neighbours, reactions
from storyloom.operators import feeds as stories
from storyloom.operators.ordered import decayed_sum, running_sum
from storyloom.operators.vector_sums import vector_sums
from storyloom.session import materialize, scratch_path
from storyloom.sources import feeds, messages, tables
from storyloom.streaming.state import KeyedTable, matched


def available_now(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run a stream through `foreachBatch` until its present input is used up."""
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    q = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode(mode).trigger(availableNow=True).start()
    )
    q.awaitTermination()


def file_stream(spark: SparkSession, folder: str, schema, glob: str | None = None, per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    return r.parquet(folder)


class BatchTable:
    """An append-only table with one folder per batch id."""

    def __init__(self, spark: SparkSession, path: str, schema) -> None:
        self.spark, self.path, self.schema = spark, path, schema

    def write(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def only(self, batch_id: int) -> DataFrame:
        """The rows of one batch; no other folder is looked at."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/batch={batch_id}")

    def read(self, before: int | None = None) -> DataFrame:
        """All rows with their `batch`, or only those of earlier batches."""
        where, root = fs.FileSystem.from_uri(self.path)
        if where.get_file_info(root).type == fs.FileType.NotFound:
            return self.spark.createDataFrame([], self.schema).withColumn("batch", F.lit(0))
        # the partition column is found by listing folders
        df = self.spark.read.option("basePath", self.path).schema(self._with_batch()).parquet(self.path)
        return df if before is None else df.filter(F.col("batch") < before)

    def _with_batch(self):
        return StructType([*self.schema.fields, StructField("batch", IntegerType())])


# --- ingest -----------------------------------------------------------------------------------------------------


class ItemStore:
    """Items by (source_type, source_id), merged by the same upsert as in batch: a micro-batch reads and rewrites the buckets of its own
    keys, whatever the table's size. What a second arrival does not overwrite (id, time of the first arrival, `extra` columns) stays."""

    def __init__(self, spark: SparkSession, path: str, extra: str = "") -> None:
        schema = f"id long, {tables.ITEM_SCHEMA}, url_normalized string, fetched_at timestamp, attempts int" + (f", {extra}" if extra else "")
        self.items = KeyedTable(spark, f"{path}/items", schema, tables.KEY)
        self.fresh = BatchTable(spark, f"{path}/fresh", self.items.schema)

    def append(self, batch: DataFrame, batch_id: int, fetched_at: Column | None = None) -> None:
        """Merge the arrivals of a batch, the last one per key by `arrival`; keys never seen before are handed to the next stage."""
        fetched_at = F.lit(None).cast("timestamp") if fetched_at is None else fetched_at
        keys = batch.select(*tables.KEY).distinct()
        new = self.items.found(keys, batch_id).filter("old is null").select(*tables.KEY)
        self.items.merge(batch, batch_id, lambda old, rows: tables.upsert(old, rows, fetched_at))
        # read from the merged table, so that a repeated batch hands over the same rows
        self.fresh.write(self.items.near(new).join(new, tables.KEY, "left_semi"), batch_id)

    def current(self) -> DataFrame:
        return self.items.read()

    def new_items(self) -> DataFrame:
        """The hand-off to the next stage: every key once, as it first came."""
        return self.fresh.read()


ARRIVALS = f"{tables.ITEM_SCHEMA}, arrival struct<modified:long,path:string,offset:long>"


def write_back(table: KeyedTable, changed: DataFrame, job: int) -> None:
    """Put the columns of `changed`, one row per key, into a table of items; the other columns, and items that are not in the table, stay
    as they are. `job` numbers the runs that change the table, so a run may be repeated."""
    columns = [c for c in changed.columns if c not in table.keys]

    def merged(old: DataFrame, rows: DataFrame) -> DataFrame:
        both = matched(old, rows, table.keys).filter("old is not null")
        value = lambda c: F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")) if c in columns else F.col(f"old.{c}")
        return both.select(*table.keys, *[value(c).alias(c) for c in table.columns if c not in table.keys])

    table.merge(materialize(changed, "changed"), job, merged)


def _schema(spark: SparkSession, ddl: str):
    return StructType.fromDDL(ddl)


def ingest_messages(lines: DataFrame, store_path: str, bad_path: str, checkpoint: str) -> ItemStore:
    """Raw message lines → item store; malformed lines go to a quarantine table and are not retried."""
    spark = lines.sparkSession
    store = ItemStore(spark, store_path)
    bad = BatchTable(spark, bad_path, _schema(spark, "value string"))

    def each(batch: DataFrame, batch_id: int) -> None:
        m = messages.parsed(batch)
        bad.write(messages.malformed(m), batch_id)
        rows = messages.items(m, ("modified", "path", "offset")).withColumn("arrival", F.struct("modified", "path", "offset"))
        store.append(rows, batch_id, F.timestamp_micros((F.col("modified") / 1000).cast("long")))

    available_now(lines, each, checkpoint)
    return store


def deduplicated(stream: DataFrame, ts: str, horizon: str = "1 day") -> DataFrame:
    """Redelivered items dropped while they are within the watermark; later repeats meet the upsert."""
    return stream.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(tables.KEY)


class PolledFeeds:
    """Entries of feeds, poll by poll, against a table of cursors that the polls themselves move. An entry is taken if it is newer than
    its feed's cutoff (the cursor, but no older than the larger of interval x factor and the floor) or has no date; the others are too
    late, and are counted per feed and poll. A poll reads the cursors of its own feeds only."""

    POLLS = "feed_name string, polled_at timestamp, cutoff timestamp, taken long, late long, new_cursor timestamp"

    def __init__(self, spark: SparkSession, path: str, entry_schema) -> None:
        self.cursors = KeyedTable(spark, f"{path}/cursors", "feed_name string, cursor string, interval_s int", ["feed_name"])
        self.taken = BatchTable(spark, f"{path}/taken", entry_schema)
        self.polls = BatchTable(spark, f"{path}/polls", StructType.fromDDL(self.POLLS))

    def declare(self, feeds_: DataFrame) -> None:
        """Feeds with their intervals and any cursors they start from, before the first poll."""
        self.cursors.merge(feeds_.select("feed_name", "cursor", "interval_s"), -1, {"cursor": F.col("new.cursor"), "interval_s": F.col("new.interval_s")})

    def each(self, batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():  # a batch that only advances the watermark
            return
        known = self.cursors.near(batch.select("feed_name").distinct(), batch_id)
        rows = feeds.with_cutoff(batch, known, F.col("polled_at"))
        late = F.coalesce(F.col("published_at") <= F.col("cutoff"), F.lit(False))
        self.taken.write(rows.filter(~late).select(*[f.name for f in self.taken.schema.fields]), batch_id)
        summed = rows.groupBy("feed_name").agg(
            F.max("polled_at").alias("polled_at"), F.max("cutoff").alias("cutoff"), F.count_if(~late).alias("taken"), F.count_if(late).alias("late"),
            F.greatest(F.max("cutoff"), F.max("published_at")).alias("new_cursor"))
        self.polls.write(summed, batch_id)
        moved = self.polls.only(batch_id).filter("feed_name is not null").select("feed_name", F.col("new_cursor").cast("string").alias("cursor"))
        self.cursors.merge(moved, batch_id, {"cursor": F.coalesce("new.cursor", "old.cursor"), "interval_s": F.col("old.interval_s")})


def poll_feeds(stream: DataFrame, path: str, checkpoint: str, horizon: str = "1 hour") -> PolledFeeds:
    """`stream(feed_name, source_type, source_id, published_at, polled_at, ...)` through the window; entries that a poll delivers twice
    count once, and entries that a later poll delivers again meet the cursor."""
    polled = PolledFeeds(stream.sparkSession, path, stream.schema)
    once = stream.withWatermark("polled_at", horizon).dropDuplicatesWithinWatermark([*tables.KEY, "polled_at"])
    available_now(once, polled.each, checkpoint)
    return polled


def processed_feed(stream: DataFrame, category: str | None = None) -> DataFrame:
    """Live feed of processed items of a category; items without one always pass."""
    df = stream.filter("processed_at is not null and skip_reason is null")
    if category:
        df = df.filter(F.col("category").isNull() | (F.col("category") == category))
    return df.select("id", "source_type", "title", "url", "category", "published_at")


def flow_events(ingested: DataFrame, processed: DataFrame) -> DataFrame:
    """Both stages as one tagged stream."""
    a = ingested.select(F.lit("ingested").alias("kind"), "id", F.coalesce("source_type", F.lit("rss")).alias("source_type"))
    b = processed.select(F.lit("processed").alias("kind"), "id", "title", "vertical", F.slice("tags", 1, 3).alias("tags"))
    return a.unionByName(b, allowMissingColumns=True)


def enrich(
    stream: DataFrame, stages: list, out_path: str, checkpoint: str, key: str = "id"
) -> KeyedTable:
    """Items through ordered stages, set at a time, into a table by their key. Items that are in it are left alone, so redelivery is
    harmless; only the keys in the buckets of a batch's keys are read to know, and the batch's items are appended."""
    from storyloom.plans.stages import run_stages

    out: list[KeyedTable] = []

    def each(batch: DataFrame, batch_id: int) -> None:
        if not out:  # the columns of the result are known once the stages have met a batch
            plain = [x for x in stages if not x.per_batch]
            added = [StructField("cluster_id", LongType()), StructField("cluster_size", LongType())] if len(plain) < len(stages) else []
            probe = stream.sparkSession.createDataFrame([], StructType([*batch.schema.fields, *added]))
            out.append(KeyedTable(stream.sparkSession, out_path, run_stages(probe, plain).schema, [key]))
        todo = materialize(out[0].unknown(batch.dropDuplicates([key]), batch_id), "todo")
        out[0].append(run_stages(todo, stages, batch_id), batch_id, keys_of=todo)

    available_now(stream, each, checkpoint)
    return out[0]


# --- clusters -----------------------------------------------------------------------------------------------------


class StoryClusters:
    """Stories that grow and merge as items come in: after any number of batches they are the components of one batch of everything.

    An item keeps the label it got at first, the smallest id of its story then; `labels` says which story a label belongs to now, and
    `under` lists the labels of a story, so when a newcomer links two stories only the labels of those absorbed are rewritten, never
    items. URLs and ids are looked up in the buckets that a batch touches. Copies of a vector are kept once."""

    def __init__(self, spark: SparkSession, path: str, key: str = "url_normalized", min_cos: float | None = None) -> None:
        self.spark, self.key, self.min_cos = spark, key, min_cos
        self.urls = KeyedTable(spark, f"{path}/urls", "story_key string, label long", ["story_key"])
        self.ids = KeyedTable(spark, f"{path}/ids", "id long, label long", ["id"])
        self.labels = KeyedTable(spark, f"{path}/labels", "label long, cluster_id long", ["label"])
        self.under = KeyedTable(spark, f"{path}/under", "cluster_id long, label long", ["cluster_id", "label"], bucket_by=["cluster_id"])
        self.sizes = KeyedTable(spark, f"{path}/sizes", "cluster_id long, size long", ["cluster_id"])
        self.vectors = BatchTable(spark, f"{path}/vectors", StructType.fromDDL("id long, vec array<float>"))
        self.links = BatchTable(spark, f"{path}/links", StructType.fromDDL("u long, v long"))
        self.assigned = BatchTable(spark, f"{path}/assigned", StructType.fromDDL("id long, story_key string, cluster_id long"))

    def each(self, batch: DataFrame, batch_id: int) -> None:
        once = batch.dropDuplicates(["id"])
        fresh = self.ids.found(once, batch_id).filter("old is null").drop("old")
        fresh = materialize(fresh.withColumn("story_key", dedup._story_key(F.col(self.key))), "newcomers")
        first = fresh.groupBy("story_key").agg(F.min("id").alias("first"))
        known = self.urls.found(first, batch_id).select("story_key", "first", F.col("old.label").alias("label"))
        links = fresh.join(known, "story_key").select(F.col("id").alias("u"), F.col("first").alias("v"))
        to_label = known.filter("label is not null").select(F.col("first").alias("u"), "label")
        if self.min_cos is not None:
            vec = fresh.filter("vec is not null").groupBy(F.col("vec").cast("array<float>").alias("vec")).agg(F.min("id").alias("id"))
            self.vectors.write(vec.select("id", "vec"), batch_id)
            own = self.vectors.only(batch_id)
            links = links.unionByName(neighbours.linked(fresh.select("id", "vec"), self.min_cos).select(F.col("id").alias("u"), F.col("neighbour_id").alias("v")))
            asked = own.select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
            met = materialize(neighbours.linked_between(asked, self.vectors.read(batch_id).select("id", "vec"), self.min_cos), "met")
            to_label = to_label.unionByName(self.ids.found(met, batch_id).select(F.col("query_id").alias("u"), F.col("old.label").alias("label")))
        to_label = materialize(to_label.distinct(), "known-labels")
        told = self.labels.found(to_label, batch_id).select("u", F.col("old.cluster_id").alias("v"))
        # an item stands for itself until it is linked; a known story is the vertex of its smallest id
        self.links.write(links.unionByName(told).distinct(), batch_id)
        links = self.links.only(batch_id)
        comp = materialize(dedup.connected_components(links), "components")
        placed = fresh.select("id", "story_key").join(comp, "id", "left").select("id", "story_key", F.coalesce("component", "id").alias("cluster_id"))
        self.assigned.write(placed, batch_id)
        placed = self.assigned.only(batch_id)
        moved = links.join(self.sizes.near(links.select(F.col("v").alias("cluster_id")), batch_id).select(F.col("cluster_id").alias("v"), "size"), "v").select(F.col("v").alias("id"), "size").distinct()
        moved = moved.join(comp, "id").select(F.col("id").alias("cluster_id"), "size", F.col("component").alias("into"))
        self._absorb(moved, placed, batch_id)

    def _absorb(self, moved: DataFrame, placed: DataFrame, batch_id: int) -> None:
        """`moved(cluster_id, size, into)` are the known stories that the batch touched, `placed` its items."""
        gone = materialize(moved.filter("cluster_id <> into"), "absorbed")
        old = self.under.near(gone, batch_id).join(gone.select("cluster_id", "into"), "cluster_id")
        new = placed.select("cluster_id").distinct()
        relabelled = materialize(
            old.select("label", F.col("into").alias("cluster_id")).unionByName(new.select(F.col("cluster_id").alias("label"), "cluster_id")).groupBy("label").agg(F.min("cluster_id").alias("cluster_id")), "relabelled")
        grown = placed.groupBy("cluster_id").agg(F.count("*").alias("n")).unionByName(gone.groupBy(F.col("into").alias("cluster_id")).agg(F.sum("size").alias("n")))
        sizes = grown.groupBy("cluster_id").agg(F.sum("n").alias("n"), F.lit(False).alias("gone")).unionByName(gone.select("cluster_id", F.lit(0).cast("long").alias("n"), F.lit(True).alias("gone")))

        def resized(old: DataFrame, rows: DataFrame) -> DataFrame:
            both = matched(old, rows, ["cluster_id"]).filter(~F.coalesce("new.gone", F.lit(False)))
            return both.select("cluster_id", (F.coalesce("old.size", F.lit(0)) + F.coalesce("new.n", F.lit(0))).alias("size"))

        def regrouped(old: DataFrame, rows: DataFrame) -> DataFrame:
            left = old.join(rows.filter("label is null").select("cluster_id"), "cluster_id", "left_anti")
            return left.unionByName(rows.filter("label is not null")).distinct()

        self.labels.merge(relabelled, batch_id, {"cluster_id": F.coalesce("new.cluster_id", "old.cluster_id")})
        emptied = gone.select("cluster_id", F.lit(None).cast("long").alias("label"))
        self.under.merge(relabelled.select("cluster_id", "label").unionByName(emptied), batch_id, regrouped)
        self.sizes.merge(sizes, batch_id, resized)
        keep = {"label": F.coalesce("old.label", "new.label")}
        self.urls.merge(placed.filter(~F.col("story_key").startswith("item:")).groupBy("story_key").agg(F.min("cluster_id").alias("label")), batch_id, keep)
        self.ids.merge(placed.select("id", F.col("cluster_id").alias("label")), batch_id, keep)

    def of(self, items: DataFrame) -> DataFrame:
        """`items` with the story they are in now and its size; only the buckets of these items and stories are read."""
        told = self.ids.found(items.select("id")).select("id", F.col("old.label").alias("label"))
        told = self.labels.found(told).select("id", F.col("old.cluster_id").alias("cluster_id"))
        told = self.sizes.found(told).select("id", "cluster_id", F.col("old.size").alias("cluster_size"))
        return items.join(told, "id", "left")

    def read(self) -> DataFrame:
        """(id, cluster_id, size) of every item as things stand."""
        now = self.ids.read().join(self.labels.read(), "label").select("id", "cluster_id")
        return now.join(self.sizes.read(), "cluster_id").select("id", "cluster_id", "size")


def assign_clusters(
    stream: DataFrame, path: str, checkpoint: str, key: str = "url_normalized", min_cos: float | None = None
) -> StoryClusters:
    """`stream(id, <key>)` into stories, each batch against those known so far. With `min_cos` the stream has vectors (`vec`) as well:
    all items that are as similar are linked, newcomers with each other and with known ones."""
    clusters = StoryClusters(stream.sparkSession, path, key, min_cos)
    available_now(stream, clusters.each, checkpoint)
    return clusters


# --- learning -----------------------------------------------------------------------------------------------------


class Learner:
    """Learning from the reaction log as it grows. Per micro-batch the clicks are numbered on the counts so far, reduced to one row
    per key by operators that spread hot keys, and merged into state tables of which only the touched buckets are read: clicks per mark
    key, weights per (vertical, tag) and per (vertical, source), the sum of liked vectors per vertical, the last mute click per
    (vertical, topic), and the standing marks per vertical. Folding n steps is w -> w * (1 - rate)^n + folded, a like that is taken
    away is subtracted, the later mute wins: so batches compose exactly. `seeds(vertical, tag, weight)` are starting weights."""

    PARTS = ("tags", "sources", "taste", "mutes", "triggers")

    def __init__(
        self, spark: SparkSession, path: str, items: DataFrame, vectors: DataFrame | None = None, rate: float = K.LEARNING_RATE,
        every: int = K.REFINE_EVERY, parts: tuple = PARTS, seeds: DataFrame | None = None,
    ) -> None:
        self.items, self.vectors, self.rate, self.every, self.seeds = items, vectors, rate, every, seeds
        self.parts = [p for p in parts if p != "taste" or vectors is not None]
        weights = "n_pos long, n_neg long, weight double"
        table = lambda name, columns, keys: KeyedTable(spark, f"{path}/{name}", columns, keys)
        self.clicks = table("clicks", "item_id long, signal string, topic string, n long", reactions.MARK_KEY)
        self.tags = table("tags", f"vertical string, tag string, {weights}", ["vertical", "tag"])
        self.sources = table("sources", f"vertical string, source_type string, source_key string, {weights}", ["vertical", "source_type", "source_key"])
        self.liked = table("taste", "vertical string, n long, total array<double>", ["vertical"])
        self.muted = table("mutes", "vertical string, tag string, at struct<ts:timestamp_ntz,event_id:long>, action string", ["vertical", "tag"])
        self.standing = table("standing", "vertical string, standing long", ["vertical"])
        self.moves = BatchTable(spark, f"{path}/moves", _schema(
            spark, "event_id long, ts timestamp_ntz, item_id long, signal string, topic string, action string, direction int, vertical string, "
            "tags array<string>, source_type string, source_key string"))
        self.refines = BatchTable(spark, f"{path}/triggers", _schema(spark, "event_id long, vertical string, item_id long, standing long"))

    def each(self, batch: DataFrame, batch_id: int) -> None:
        key = reactions.MARK_KEY
        wanted = F.col("signal").isin(*reactions.LEARNABLE)
        if "mutes" in self.parts:
            wanted = wanted | ((F.col("signal") == "mute_topic") & F.col("topic").isNotNull())
        clicks = batch.filter(wanted)
        counts = clicks.groupBy(*key).agg(F.count("*").alias("n"))
        before = self.clicks.found(counts.select(*key), batch_id).select(*[F.col(k).alias(f"_b_{k}") for k in key], F.coalesce("old.n", F.lit(0)).alias("_before"))
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in key])
        nth = running_sum(clicks, key, ["ts", "event_id"], F.lit(1), "nth").join(before, same, "left").withColumn("nth", F.col("nth") + F.col("_before"))
        sign = F.when(F.col("signal").isin(*reactions.LIKES), 1).otherwise(-1)
        facts = self.items.filter("vertical is not null").select(
            F.col("id").alias("item_id"), "vertical", "tags", "source_type", F.coalesce(F.nullif("feed_name", F.lit("")), "author", F.lit("")).alias("source_key"))
        moves = nth.join(facts, "item_id").withColumn("action", F.when(F.col("nth") % 2 == 1, "added").otherwise("removed")).withColumn(
            "direction", F.when(F.col("action") == "added", sign).otherwise(-sign))
        self.moves.write(moves.select(*[f.name for f in self.moves.schema.fields]), batch_id)  # numbered once, read by each part
        moves = self.moves.only(batch_id)
        for part in self.parts:
            getattr(self, f"_{part}")(moves, batch_id)
        self.clicks.merge(counts, batch_id, {"n": F.coalesce("old.n", F.lit(0)) + F.coalesce("new.n", F.lit(0))})

    def _fold(self, table: KeyedTable, steps: DataFrame, batch_id: int, seeds: DataFrame | None) -> None:
        folded = decayed_sum(steps, table.keys, ["ts", "event_id"], F.col("direction"), self.rate)
        if seeds is None:
            folded = folded.withColumn("seed", F.lit(0.0))
        else:
            folded = folded.join(seeds.select(*table.keys, F.col("weight").alias("seed")), table.keys, "left")
        first = F.coalesce("old.weight", "new.seed", F.lit(0.0))
        table.merge(folded, batch_id, {
            "n_pos": F.coalesce("old.n_pos", F.lit(0)) + F.coalesce("new.n_pos", F.lit(0)),
            "n_neg": F.coalesce("old.n_neg", F.lit(0)) + F.coalesce("new.n_neg", F.lit(0)),
            "weight": first * F.pow(F.lit(1.0 - self.rate), F.coalesce("new.n", F.lit(0))) + F.coalesce("new.w", F.lit(0.0)),
        })

    def _tags(self, moves: DataFrame, batch_id: int) -> None:
        steps = moves.filter(F.col("signal").isin(*reactions.LEARNABLE)).withColumn("tag", F.explode("tags"))
        self._fold(self.tags, steps, batch_id, self.seeds)

    def _sources(self, moves: DataFrame, batch_id: int) -> None:
        self._fold(self.sources, moves.filter(F.col("signal").isin(*reactions.LEARNABLE)), batch_id, None)

    def _taste(self, moves: DataFrame, batch_id: int) -> None:
        net = moves.filter(F.col("signal").isin(*reactions.LIKES)).groupBy("item_id", "vertical").agg(F.sum("direction").alias("times")).filter("times <> 0")
        liked = net.join(self.vectors.select(F.col("id").alias("item_id"), "vec"), "item_id")
        both = F.when(F.col("old").isNull(), F.col("new.total")).when(F.col("new").isNull(), F.col("old.total")).otherwise(
            F.zip_with("old.total", "new.total", lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))))
        self.liked.merge(vector_sums(liked, ["vertical"], "vec", "times"), batch_id, {
            "n": F.coalesce("old.n", F.lit(0)) + F.coalesce("new.n", F.lit(0)), "total": both})

    def _mutes(self, moves: DataFrame, batch_id: int) -> None:
        at = F.struct("ts", "event_id")
        last = moves.filter("signal = 'mute_topic'").groupBy("vertical", F.col("topic").alias("tag")).agg(F.max(at).alias("at"), F.max_by("action", at).alias("action"))
        later = F.col("old").isNull() | (F.col("new.at") > F.col("old.at"))
        self.muted.merge(last, batch_id, {c: F.when(later, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")) for c in ("at", "action")})

    def _triggers(self, moves: DataFrame, batch_id: int) -> None:
        steps = moves.filter(F.col("signal").isin(*reactions.LEARNABLE)).withColumn("delta", F.when(F.col("action") == "added", 1).otherwise(-1))
        ranked = running_sum(steps.select("event_id", "ts", "item_id", "vertical", "action", "delta"), ["vertical"], ["ts", "event_id"], F.col("delta"), "_own")
        sums = steps.groupBy("vertical").agg(F.sum("delta").alias("standing"))
        before = self.standing.found(sums.select("vertical"), batch_id).select("vertical", F.coalesce("old.standing", F.lit(0)).alias("_before"))
        counted = ranked.join(F.broadcast(before), "vertical").withColumn("standing", F.col("_own") + F.col("_before"))  # a row per topic area
        hit = (F.col("action") == "added") & (F.col("standing") > 0) & (F.col("standing") % self.every == 0)
        self.refines.write(counted.filter(hit).select("event_id", "vertical", "item_id", "standing"), batch_id)
        self.standing.merge(sums, batch_id, {"standing": F.coalesce("old.standing", F.lit(0)) + F.coalesce("new.standing", F.lit(0))})

    # what has been learned so far

    def affinity(self) -> DataFrame:
        """(vertical, tag, weight, n_pos, n_neg); tags that no click has moved keep their seed."""
        own = self.tags.read().select("vertical", "tag", "weight", "n_pos", "n_neg")
        if self.seeds is None:
            return own
        rest = self.seeds.select("vertical", "tag", "weight").join(own, ["vertical", "tag"], "left_anti")
        return own.unionByName(rest.withColumn("n_pos", F.lit(0)).withColumn("n_neg", F.lit(0)))

    def source_affinity(self) -> DataFrame:
        return self.sources.read().select("vertical", "source_type", "source_key", "weight", "n_pos", "n_neg")

    def taste(self) -> DataFrame:
        """(vertical, n_liked, vec): the mean vector of the standing likes."""
        rows = self.liked.read().filter("n > 0")
        return rows.select("vertical", F.col("n").alias("n_liked"), F.transform("total", lambda x: x / F.col("n")).alias("vec"))

    def mutes(self) -> DataFrame:
        return self.muted.read().filter("action = 'added'").select("vertical", "tag")

    def triggers(self) -> DataFrame:
        return self.refines.read().drop("batch")


def learn(
    stream: DataFrame, items: DataFrame, path: str, checkpoint: str, vectors: DataFrame | None = None, parts: tuple = Learner.PARTS,
    seeds: DataFrame | None = None,
) -> Learner:
    learner = Learner(stream.sparkSession, path, items, vectors, parts=parts, seeds=seeds)
    available_now(stream, learner.each, checkpoint)
    return learner


# --- windows ------------------------------------------------------------------------------------------------------


def daily_tag_counts(stream: DataFrame, ts: str = "sort_ts", late: str = "2 days") -> DataFrame:
    """Tumbling daily counts and mean score per tag; the trend base of a day is made of earlier windows."""
    return (
        stream.withWatermark(ts, late)
        .select(F.col(ts), F.explode("tags").alias("tag"), "personal_score")
        .groupBy(F.window(ts, "1 day"), "tag")
        .agg(F.count("*").alias("n"), F.avg("personal_score").alias("avg_score"))
        .select(F.col("window.start").alias("day"), "tag", "n", "avg_score")
    )


class TagTiles:
    """Daily tiles of tags that items add to as they come, in any order; rolling windows of days, weeks and months are sums of tiles, so
    neither the items nor their history are read again."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.tiles = KeyedTable(spark, path, "tile timestamp_ntz, vertical string, tag string, n long, scored long, score_sum double", ["tile", "vertical", "tag"], bucket_by=["tile"])

    def each(self, batch: DataFrame, batch_id: int) -> None:
        add = lambda c: F.coalesce(f"old.{c}", F.lit(0)) + F.coalesce(f"new.{c}", F.lit(0))
        self.tiles.merge(materialize(stories.tag_tiles(batch), "tiles"), batch_id, {c: add(c) for c in ("n", "scored", "score_sum")})

    def trends(self, as_of: Column, period: str = "day", vertical: str | None = None) -> DataFrame:
        return stories.trends_of(stories.tile_windows(self.tiles.read(), as_of, period, vertical), period)


def tile_tags(stream: DataFrame, path: str, checkpoint: str) -> TagTiles:
    tiles = TagTiles(stream.sparkSession, path)
    available_now(stream, tiles.each, checkpoint)
    return tiles


def latest_windows(counts: DataFrame, path: str, checkpoint: str, key: list[str]) -> DataFrame:
    """The current state of every window, those still open included: a batch appends the windows it changed, and the
    last version of each is read."""
    store = BatchTable(counts.sparkSession, path, counts.schema)
    query = counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(store.write).start()
    query.awaitTermination()
    newest = Window.partitionBy(*key).orderBy(F.desc("batch"))
    return store.read().withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn", "batch")


def checkpoint_for(spark: SparkSession, label: str) -> str:
    return scratch_path(spark, f"checkpoint-{label}")
