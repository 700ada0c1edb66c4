"""Streams agree with their batch twins, resume where they stopped, and survive repeats."""

from __future__ import annotations

import math
import os
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.operators import reactions
from storyloom.operators.vector_sums import vector_sums
from storyloom.plans import stages
from storyloom.sources import feeds, messages, tables, tail
from storyloom.streaming import flow, limiter
from storyloom.streaming.state import KeyedTable

from test_operators import CLICKS, ITEM_ROWS, ITEMS, T0, clicks_fixture


def write_slices(spark, rows, schema, folder, n):
    """`rows` in order as n files, read one per batch."""
    size = -(-len(rows) // n)
    for i in range(n):
        part = rows[i * size : (i + 1) * size]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/part{i}")


def test_learner_equals_batch_over_many_batches(spark, tmp_path):
    rows = clicks_fixture(300, seed=5)
    items, events = spark.createDataFrame(ITEM_ROWS, ITEMS), spark.createDataFrame(rows, CLICKS)
    vectors = spark.createDataFrame([(i, [float(i), 1.0, -i / 3]) for i in range(5)], "id long, vec array<float>")
    seeds = spark.createDataFrame([("it", "a", 0.8), ("it", "unmoved", -0.5)], "vertical string, tag string, weight double")
    learner = flow.Learner(spark, str(tmp_path / "state"), items, vectors, every=3, seeds=seeds)
    for b in range(4):
        batch = spark.createDataFrame(rows[b * 75 : (b + 1) * 75], CLICKS)
        learner.each(batch, b)
        if b == 2:
            learner.each(batch, b)  # a repeated batch changes nothing
    learner.each(events.limit(0), 4)  # nor does an empty one
    steps, marks = reactions.learning_steps(events, items), reactions.current_marks(events)

    def same(got, want, keys, values):
        got, want = ({tuple(r[k] for k in keys): [r[v] for v in values] for r in df.collect()} for df in (got, want))
        assert got.keys() == want.keys() and len(got) > 0
        for k in want:
            for x, y in zip(got[k], want[k]):
                assert x == pytest.approx(y, abs=1e-6)

    same(learner.affinity(), reactions.tag_affinity(steps, seeds), ["vertical", "tag"], ["weight", "n_pos", "n_neg"])
    same(learner.source_affinity(), reactions.source_affinity(steps), ["vertical", "source_type", "source_key"], ["weight", "n_pos", "n_neg"])
    same(learner.taste(), reactions.taste(marks, items, vectors), ["vertical"], ["n_liked", "vec"])
    same(learner.mutes(), reactions.learned_mutes(events, items), ["vertical", "tag"], [])
    same(learner.triggers(), reactions.refine_triggers(events, items, 3), ["event_id"], ["vertical", "item_id", "standing"])


def test_keyed_table_rewrites_touched_buckets_only(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", "k string, n long", ["k"], buckets=8)
    add = {"n": F.coalesce("old.n", F.lit(0)) + F.coalesce("new.n", F.lit(0))}
    df = lambda *rows: spark.createDataFrame(list(rows), "k string, n long")
    rows = lambda before=None: {r.k: r.n for r in t.read(before).collect()}
    assert rows() == {}
    t.merge(df(*[(str(i), i) for i in range(40)], (None, 7)), 0, add)
    t.merge(df(("3", 100), (None, 1), ("new", 5)), 1, add)
    t.merge(df(("3", 100), (None, 1), ("new", 5)), 1, add)  # repeated
    want = {str(i): i for i in range(40)} | {None: 7}
    assert rows(1) == want and rows() == want | {"3": 103, None: 8, "new": 5}
    versions = t._current(None)
    assert 1 <= list(versions.values()).count(1) <= 3 and set(versions.values()) == {0, 1}
    assert {r.k: r.old and r.old.n for r in t.found(df(("3", 0), ("zz", 0))).collect()} == {"3": 103, "zz": None}
    t.merge(df(("3", 1)), 2, add)
    t.merge(df(("3", 1)), 3, lambda old, new: old.join(new.select("k"), "k", "left_anti"))  # rows may go
    assert "3" not in rows() and rows()["5"] == 5 and t._versions() == [2, 3]
    on_disk = {(p.parent.name, p.name) for p in (tmp_path / "t" / "data").glob("v=*/bucket=*")}
    named = {(f"v={v}", f"bucket={b}") for k in (2, 3) for b, v in t._listed(k)["versions"].items()}
    assert on_disk == named  # files that no list names are gone
    assert KeyedTable(spark, str(tmp_path / "t"), "k string, n long", ["k"], buckets=3).buckets == 8


def test_vector_sums_take_nulls_sizes_and_weights(spark):
    rows = [("a", [1.0, 2.0], 1), ("a", [3.0, None], -2), (None, [1.0], 1), (None, [5.0], 2), ("b", None, 1), ("b", [], 1), ("c", [1.0], 1), ("c", [1.0, 4.0], 1)]
    df = spark.createDataFrame([r * 1 for r in rows for _ in range(3)], "k string, vec array<float>, times int").repartition(4)
    got = {r.k: (r.n, r.total) for r in vector_sums(df, ["k"], "vec", "times").collect()}
    assert got == {"a": (-3, [-15.0, 6.0]), None: (9, [33.0]), "c": (6, [6.0, 12.0])}


def test_line_tail_offsets(tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_bytes(b'one\ntwo\n\nthr')
    reader = tail.LineTailReader({"path": str(tmp_path), "splitbytes": "3"})
    first = reader.latestOffset()
    assert first == {str(f): 9}
    lines = [r[2] for p in reader.partitions({}, first) for r in reader.read(p)]
    assert lines == ["one", "two"]
    f.write_bytes(b'one\ntwo\n\nthree\nfour\n')
    second = reader.latestOffset()
    assert [r[2] for p in reader.partitions(first, second) for r in reader.read(p)] == ["three", "four"]
    f.write_bytes(b"fresh\n")  # replaced by a shorter file
    assert [r[2] for p in reader.partitions(second, reader.latestOffset()) for r in reader.read(p)] == ["fresh"]


def test_line_tail_takes_uris_and_refuses_missing_folders(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_bytes(b"one\ntwo\n")
    for root in (f"file://{tmp_path}", f"file:{tmp_path}", str(tmp_path)):
        reader = tail.LineTailReader({"path": root})
        assert [r[2] for p in reader.partitions({}, reader.latestOffset()) for r in reader.read(p)] == ["one", "two"]
    with pytest.raises(FileNotFoundError):
        tail.LineTailReader({"path": f"file://{tmp_path}/none"}).latestOffset()


def test_of_two_files_the_later_line_wins(spark, tmp_path):
    tail.register(spark)
    src = tmp_path / "in"
    src.mkdir()
    for name, text, at in (("a.jsonl", "new", 2_000_000_000), ("b.jsonl", "old", 1_000_000_000)):
        (src / name).write_text(f'{{"source_id":"1","text":"{text}"}}\n')
        os.utime(src / name, (at, at))
    lines = spark.readStream.format("line_tail").option("path", f"file://{src}").load()
    store = flow.ingest_messages(lines, str(tmp_path / "store"), str(tmp_path / "bad"), str(tmp_path / "ck"))
    assert [r.text for r in store.current().collect()] == ["new"]


def test_line_tail_stream_resumes(spark, tmp_path):
    tail.register(spark)
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    f = src / "x.jsonl"

    def run():
        flow.run_to_table(spark.readStream.format("line_tail").option("path", str(src)).load(), out, ck)
        return sorted(r.value for r in spark.read.parquet(out).collect())

    f.write_text('{"source_id":"1:1","text":"hello"}\n{"source_id":"1:2"')
    assert run() == ['{"source_id":"1:1","text":"hello"}']
    f.write_text('{"source_id":"1:1","text":"hello"}\n{"source_id":"1:2"}\nbroken\n')
    assert len(run()) == 3
    rows = messages.parsed(spark.read.parquet(out).select("value"))
    assert sorted(r.source_id for r in messages.items(rows).collect()) == ["1:1", "1:2"]
    assert [r.value for r in messages.malformed(rows).collect()] == ["broken"]


def test_message_categories(apply):
    assert apply(messages.category_of, ["news_ai", "news_tech", "other", None]) == ["ai", "tech", "other", None]


def test_clusters_of_several_batches_use_vectors(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "id long, url_normalized string, vec array<float>"
    batches = [
        [(1, "u1", [1.0, 0.0, 0.0]), (2, "u2", [0.99, 0.05, 0.0]), (3, "u3", [0.0, 1.0, 0.0]), (4, None, None)],  # 1 and 2 are alike
        [(5, "u3", [1.0, 0.0, 0.1]), (6, "u6", [0.0, 0.0, 1.0]), (7, "u7", [0.0, 0.99, 0.0]), (8, "u6", None), (9, "u9", [0.0, 0.1, 1.0])],
    ]
    for part in batches:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        out = flow.assign_clusters(spark.readStream.schema(schema).parquet(src), str(tmp_path / "out"), str(tmp_path / "ck"), min_cos=0.9)
    got = {r.id: r.cluster_id for r in out.read().collect()}
    # 5 has the URL of 3 and the vector of 1: it joins two stories
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 1, 6: 6, 7: 1, 8: 6, 9: 6}


def test_batches_of_items_merge_stories_like_one_batch(spark, tmp_path):
    """Chains of URLs and vectors whose middle arrives last, items sent again, a batch repeated, and smaller ids that come later."""
    rng = random.Random(4)
    schema = "id long, url_normalized string, vec array<float>"
    angle = lambda a: [math.cos(a), math.sin(a), 0.1 * (a > 3)]
    rows = [(i, rng.choice([f"u{rng.randrange(25)}", f"w{i}", None]), angle(rng.randrange(60) / 10) if rng.random() < 0.7 else None) for i in range(70)]
    rng.shuffle(rows)
    vecs = {i: v for i, _, v in rows}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vecs.items() if v}
    links = [(a, b) for a, u, _ in rows for b, w, _ in rows if a < b and ((u and u == w) or (a in unit and b in unit and unit[a] @ unit[b] >= 0.9995))]
    parent = {i: i for i in vecs}
    for _ in range(70):
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    clusters = flow.StoryClusters(spark, str(tmp_path / "state"), min_cos=0.9995)
    for n, cut in enumerate((0, 20, 45, 70)):
        part = rows[max(0, cut - 30) : cut]  # some rows come again
        clusters.each(spark.createDataFrame(part, schema), n)
        if n == 2:
            clusters.each(spark.createDataFrame(part, schema), n)
    got = clusters.read().collect()
    assert {r.id: r.cluster_id for r in got} == parent
    assert all(r.size == list(parent.values()).count(r.cluster_id) for r in got)
    assert {r.cluster_id: r.size for r in clusters.sizes.read().collect()} == {c: list(parent.values()).count(c) for c in set(parent.values())}


def test_groups_of_copies_do_not_hide_a_link(spark, tmp_path):
    """Two groups of 15 alike vectors, equal and nearly so, whose nearest are their own: one story all the same."""
    src, schema = str(tmp_path / "in"), "id long, url_normalized string, vec array<float>"
    rows = [(k, f"u{k}", [1.0, 0.001 * (k % 5), 0.0] if k < 15 else [0.9, 0.43, 0.001 * (k % 5)]) for k in range(30)] + [(30, "u30", [0.0, 0.0, 1.0])]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    out = flow.assign_clusters(spark.readStream.schema(schema).parquet(src), str(tmp_path / "out"), str(tmp_path / "ck"), min_cos=0.85)
    assert {r.id: r.cluster_id for r in out.read().collect()} == dict.fromkeys(range(30), 0) | {30: 30}


def test_item_store_keeps_first_and_last(spark, tmp_path):
    store = flow.ItemStore(spark, str(tmp_path / "store"), extra="score double")

    def batch(*rows):
        return spark.createDataFrame([("rss", k, None, t, None, [], None, "f", None, None, None, (n, "f", n)) for n, (k, t) in enumerate(rows)], flow.ARRIVALS)

    at = F.timestamp_seconds(F.col("arrival.modified") + 100)
    store.append(batch(("1", "a"), ("2", "b"), ("1", "a2")), 0, at)
    first = {r.source_id: r for r in store.current().collect()}
    store.items.merge(store.current().select(*tables.KEY), 1, lambda old, rows: old.withColumn("score", F.lit(0.5)))  # a later stage writes
    store.append(batch(("1", "c"), ("3", "d")), 2, at)
    store.append(batch(("1", "c"), ("3", "d")), 2, at)  # repeated
    now = {r.source_id: r for r in store.current().collect()}
    assert {k: r.title for k, r in now.items()} == {"1": "c", "2": "b", "3": "d"}
    assert now["1"].id == first["1"].id and now["1"].fetched_at == first["1"].fetched_at == datetime(1970, 1, 1, 0, 1, 42) and now["1"].score == 0.5 and now["3"].score is None
    assert sorted((r.source_id, r.title) for r in store.new_items().collect()) == [("1", "a2"), ("2", "b"), ("3", "d")]


def test_tagger_and_judge_answers_are_read(spark):
    schema = "id long, title string, text string, feed_name string, tags array<string>, vertical string, skip_reason string, llm_relevance double, scored_profile_version long"
    answers = {"1": 'sure: {"tags": [" AI ", "", "Go"], "vertical": "IT", "insight": 1.7}', "2": "broken", "3": '{"vertical": "other", "insight": -1}', "4": '{"tags": ["x"]}'}
    rows = [(i, str(i), "", "f", ["old"], "it", "muted" if i == 4 else None, None, None) for i in range(1, 6)] + [(6, None, "", "f", ["old"], "it", None, 0.3, 2)]
    df = spark.createDataFrame(rows, schema)
    got = {r.id: r for r in stages.run_stages(df, [stages.tagger_stage(lambda b: [answers.get(t) for t in b["title"]])]).collect()}
    assert (got[1].tags, got[1].vertical, got[1].insight_score) == (["ai", "go"], "it", 1.0)
    assert (got[2].tags, got[2].vertical, got[2].insight_score) == (["old"], "it", None)
    assert (got[3].tags, got[3].vertical, got[3].insight_score) == (["old"], None, 0.0)
    assert got[4].tags == got[5].tags == got[6].tags == ["old"]
    active = spark.createDataFrame([("it", 2)], "vertical string, version long")
    said = {"1": '{"score": 3}', "2": '{"score": "0.25"}', "3": "no"}
    judged = {r.id: r for r in stages.judge_stage(active, ["title"], lambda b: [said.get(t, '{"score": 0.9}') for t in b["title"]]).apply(df).collect()}
    assert [(judged[i].llm_relevance, judged[i].scored_profile_version) for i in range(1, 7)] == [(1.0, 2), (0.25, 2), (None, None), (None, None), (0.9, 2), (0.3, 2)]


def brute_limit(rows, cap, minutes):
    out, sent = [], {}
    for user, ts, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        s = sent.setdefault(user, [])
        if sum(1 for t in s if t >= ts - timedelta(minutes=minutes)) < cap:
            s.append(ts)
            out.append(i)
    return sorted(out)


def limiter_rows():
    rng, t, rows = random.Random(2), T0, []
    for i in range(400):
        t += timedelta(minutes=rng.choice([0, 1, 3, 9, 61, 130]))
        rows.append((1 if rng.random() < 0.6 else rng.randrange(4), t, i))
    return rows


def test_rate_limit_matches_brute_force(spark):
    rows = limiter_rows()
    df = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, id long")
    assert sorted(r.id for r in limiter.limited(df, 3).collect()) == brute_limit(rows, 3, 60)


def test_rate_limit_stream_matches_batch(spark, tmp_path):
    rows = limiter_rows()
    src = str(tmp_path / "in")
    schema = "user_id long, ts timestamp_ntz, id long"
    ck, out = str(tmp_path / "ck"), str(tmp_path / "out")
    half = len(rows) // 2
    for part in (rows[:half], rows[half:]):  # two runs, state carried by the checkpoint
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        stream = limiter.limited_stream(spark.readStream.schema(schema).parquet(src), 3)
        flow.run_to_table(stream, out, ck)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == brute_limit(rows, 3, 60)


def test_cutoff(apply):
    now = "2024-01-10 12:00:00"
    fn = lambda c, i: feeds.cutoff(c, i, F.lit(now).cast("timestamp"))
    rows = [(None, 3600), ("2024-01-10T11:00:00", 3600), ("2024-01-01T00:00:00+00:00", 3600), ("broken", 3600), (None, 86400 * 2)]
    got = apply(fn, rows, "c string, i int")
    day = datetime(2024, 1, 9, 12)
    assert got == [day, datetime(2024, 1, 10, 11), day, day, datetime(2024, 1, 7, 12)]


RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:media="http://search.yahoo.com/mrss/"><channel><title>F</title>
<item><title>&lt;b&gt;One&lt;/b&gt; &amp;amp; more</title><link>https://e.com/1</link><guid isPermaLink="false">g1</guid><pubDate>Wed, 10 Jan 2024 07:00:00 GMT</pubDate>
<description>&lt;p&gt;Text&lt;/p&gt;</description><enclosure url="https://e.com/1.mp3" type="a"/><media:content url="https://e.com/1.jpg"/></item>
<item><title>Two</title><link>https://e.com/2</link><pubDate>Wed, 10 Jan 2024 11:00:00 +0000</pubDate><description>Comments</description></item>
</channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>a1</id><title>Atom</title><link href="https://e.com/a"/><link rel="enclosure" href="https://e.com/a.mp3"/>
<updated>2024-01-10T10:00:00Z</updated><summary>Sum</summary><author><name>Ann</name></author></entry></feed>"""


def test_feed_files(spark, tmp_path):
    (tmp_path / "rss").mkdir(), (tmp_path / "atom").mkdir()
    (tmp_path / "rss" / "hn.xml").write_text(RSS)
    (tmp_path / "atom" / "blog.xml").write_text(ATOM)
    one, two = feeds.read_rss(spark, str(tmp_path / "rss")).orderBy("published_at").collect()
    assert (one.source_id, one.title, one.text, one.feed_name, one.author) == ("g1", "One & more", "Text", "hn", "hn")
    assert sorted(one.media) == ["https://e.com/1.jpg", "https://e.com/1.mp3"]
    assert (two.source_id, two.text, two.published_at) == ("https://e.com/2", None, datetime(2024, 1, 10, 11))
    atom = feeds.read_atom(spark, str(tmp_path / "atom")).first()
    assert (atom.source_id, atom.url, atom.text, atom.author, atom.media, atom.published_at) == ("a1", "https://e.com/a", "Sum", "Ann", ["https://e.com/a.mp3"], datetime(2024, 1, 10, 10))


def test_api_cursor_counts_filtered_rows(spark):
    df = spark.createDataFrame([("""{"entries":[{"id":10,"feed":{"title":"F","category":{"title":"Tech"}}},{"id":12,"feed":{"category":{"title":"AI"}}}]}""",)], "value string")
    e = feeds.api_entries(df.select(F.from_json("value", feeds.ENTRIES_SCHEMA).alias("p")).select("p.entries"))
    assert [r.source_id for r in feeds.api_items(e, ("tech",)).collect()] == ["10"]
    assert feeds.api_cursor(e, 5).first().cursor == 12
    assert feeds.api_cursor(e.limit(0), 5).first().cursor == 5


def test_empty_listing_fails(spark):
    pages = spark.createDataFrame([("a", 0, '<a href="/o/r" data-view-component>'), ("b", 0, "<p>")], "topic string, list_no int, html string")
    ok = pages.filter("topic = 'a'")
    assert [r.slug for r in feeds.checked_not_empty(ok, feeds.listing_links(ok)).collect()] == ["o/r"]
    with pytest.raises(Exception, match="no repository links"):
        feeds.checked_not_empty(pages, feeds.listing_links(pages)).collect()


@pytest.mark.parametrize("files", [1, 3])
def test_tables_in_folders_are_streamed(spark, tmp_path, files):
    from storyloom.plans import catalog

    docs = spark.createDataFrame([(i, f"Title {i}\nof the text", "en", "feed", 20) for i in range(1, 13)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(files).write.parquet(str(tmp_path / "made"))
    if files == 1:
        (part,) = (tmp_path / "made").glob("*.parquet")
        os.rename(part, tmp_path / "documents.parquet")
    else:
        os.rename(tmp_path / "made", tmp_path / "documents.parquet")
    got = catalog.queries()["j1_enrichment"](spark, str(tmp_path)).collect()
    assert sorted(r.id for r in got) == list(range(1, 13)) and {r.watch_topics for r in got} == {"Of the"}


def test_appended_rows_leave_the_others_unread(spark, tmp_path):
    """Buckets of several versions are read as one, are found and repeated like others, and become one version when there are many."""
    t = KeyedTable(spark, f"file://{tmp_path}/t", "k long, n long", ["k"], buckets=2)
    df = lambda *ks: spark.createDataFrame([(k, k and 10 * k) for k in ks], "k long, n long")
    rows = lambda before=None: sorted((r.k or 0, r.n or 0) for r in t.read(before).collect())
    first = df(None, *range(1, 20))
    t.append(first, 0, keys_of=first)
    for _ in range(2):  # a repeated batch counts once
        new = t.unknown(df(None, 3, 20, 21, 22, 23, 24, 25), 1)
        t.append(new, 1, keys_of=new)
    assert rows() == [(0, 0), *((k, 10 * k) for k in range(1, 26))] and rows(1) == rows()[:20]
    assert t._current(None) == {"0": [0, 1], "1": [0, 1]} and t.unknown(df(None, 7, 25)).count() == 0
    for b in range(2, 20):
        new = df(*range(10 * b + 10, 10 * b + 20))
        t.append(new, b, keys_of=new)
    assert len(rows()) == 206 and all(len(v if isinstance(v, list) else [v]) <= 16 for v in t._current(None).values())
    on_disk = {(p.parent.name, p.name) for p in (tmp_path / "t" / "data").glob("v=*/bucket=*")}
    parts = lambda v: v if isinstance(v, list) else [v]
    assert on_disk == {(f"v={v}", f"bucket={b}") for k in (18, 19) for b, vs in t._listed(k)["versions"].items() for v in parts(vs)}
    t.merge(df(3).select("k", F.lit(1).cast("long").alias("n")), 20, {"n": F.coalesce("new.n", "old.n")})
    assert len(rows()) == 206 and (3, 1) in rows()


def test_enrichment_appends_and_reads_its_items_once_per_model(spark, tmp_path):
    """No stage before a model is planned once per side of a union, and an item that comes again changes nothing."""
    schema = "id long, title string, text string, feed_name string, tags array<string>, vertical string, skip_reason string"
    df = spark.createDataFrame([(i, f"t{i}", None if i % 3 else "x", "f", ["a"], "it", "muted" if i % 4 == 0 else None) for i in range(12)], schema)
    chain = [stages.tagger_stage(lambda b: ['{"tags": ["new"]}'] * len(b)), *[stages.model_stage(f"m{k}", 5 + k, ["text"], lambda b: list(b["text"]), f"m{k}") for k in range(4)]]
    plan = stages.run_stages(df, chain)._jdf.queryExecution().analyzed().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    src, args = str(tmp_path / "in"), (str(tmp_path / "out"), str(tmp_path / "ck"))
    for part in ("id < 8", "id > 4"):
        df.filter(part).coalesce(1).write.mode("append").parquet(src)
        out = flow.enrich(spark.readStream.schema(schema).parquet(src), chain, *args)
    got = {r.id: (r.tags, r.m3) for r in out.read().collect()}
    assert got == {i: (["a"], None) if i % 4 == 0 else (["new"], None if i % 3 else "x") for i in range(12)}
    assert {v for vs in out._current(None).values() for v in (vs if isinstance(vs, list) else [vs])} == {0, 1} and out.read().count() == 12


def test_texts_are_read_once_for_all_stretches_of_stories(spark, tmp_path, monkeypatch):
    from storyloom.plans import catalog, catalog_sources

    docs = spark.createDataFrame([(i, f"text {i % 7}", "en", "feed", 6) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    cut, read = catalog_sources._arrivals, []
    monkeypatch.setattr(catalog_sources, "_arrivals", lambda spark, rows, *more: read.extend(rows.inputFiles()) or cut(spark, rows, *more))
    got = {r.id: r.cluster_id for r in catalog.queries()["j5_streaming_clusters"](spark, str(tmp_path)).collect()}
    alone = lambda i: i % 37 == 0 or i % 10 in (6, 9)
    assert got == {i: i if alone(i) else min(k for k in range(40) if k % 7 == i % 7 and not alone(k)) for i in range(40)}
    assert read and not any("documents.parquet" in f for f in read)
