"""Distributed operators against brute force on small fixtures, and their invariants."""

from __future__ import annotations

import math
import random
import re
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storyloom import session
from storyloom.operators import dedup, feeds, knowledge, lexical_index, neighbours, ordered, profiles, reactions, retrieval, scoring
from storyloom.operators.lexical_index import LexicalIndex
from storyloom.plans import tables as T
from storyloom.sources import feeds as ingest
from storyloom.sources import tables as S

T0 = datetime(2024, 1, 1)


def brute(vecs, floor, k):
    ids = sorted(vecs)
    m = np.array([vecs[i] for i in ids], dtype=np.float32).astype(np.float64)
    n = np.linalg.norm(m, axis=1)
    cos = (m @ m.T) / np.outer(n, n)
    out = {}
    for a, i in enumerate(ids):
        found = sorted(((-round(float(cos[a, b]), 9), j) for b, j in enumerate(ids) if j != i and cos[a, b] >= floor))[:k]
        out[i] = [(j, round(-c, 6)) for c, j in found]
    return out


def vector_fixture():
    """Random directions, a dense clump, and a third of all rows identical."""
    rng = np.random.default_rng(7)
    vecs = {i: rng.normal(size=8) for i in range(60)}
    centre = rng.normal(size=8)
    vecs.update({100 + i: centre + 0.05 * rng.normal(size=8) for i in range(40)})
    copy = rng.normal(size=8)
    vecs.update({200 + i: copy for i in range(50)})
    return {i: [float(np.float32(x)) for x in v] for i, v in vecs.items()}


@pytest.mark.parametrize("block_rows,floor", [(4096, 0.8), (8, 0.8), (16, 0.2)])
def test_neighbours_match_brute_force(spark, block_rows, floor):
    vecs = vector_fixture()
    df = spark.createDataFrame([(i, v) for i, v in vecs.items()] + [(999, [0.0] * 8), (998, None)], "id long, vec array<float>")
    got = {}
    for r in neighbours.neighbours(df, floor, 5, block_rows).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.neighbour_id, round(r.cos, 6)))
    want = {i: v for i, v in brute(vecs, floor, 5).items() if v}
    assert got.keys() == want.keys()
    for i in want:
        assert [c for _, c in got[i]] == pytest.approx([c for _, c in want[i]], abs=2e-6)
        if i >= 200:  # copies tie at 1: the smaller ids win
            assert [j for j, _ in got[i]] == [j for j, _ in want[i]]


def test_rows_moved_for_neighbours_do_not_grow_with_the_number_of_blocks(spark):
    """Every pair of blocks of these may hold a similar pair; a row goes to as many meetings as there are groups, not blocks."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(1024, 8)))]
    df = spark.createDataFrame(rows, "id long, vec array<float>").cache()
    for block_rows in (4, 16):  # 256 and 64 blocks
        moved, _ = neighbours._meetings(df, 0.0, block_rows)
        assert 1024 <= moved.count() <= 1024 * 2 * neighbours.GROUPS
    want = brute(dict(rows), 0.9, 3)
    got = neighbours.neighbours(df, 0.9, 3, 4).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "neighbour_id"))).alias("f")).collect()
    assert {r.id: [x.neighbour_id for x in r.f] for r in got} == {i: [j for j, _ in v] for i, v in want.items() if v}


def test_pages_lose_nothing_within_a_second(spark):
    rows = [(k, f"2024-01-01 00:00:00.{k:06d}", f"2024-01-01 00:00:00.{k:06d}") for k in range(1, 7)]
    df = spark.createDataFrame(rows, "id long, sort_ts string, processed_at string").select(
        "id", F.col("sort_ts").cast("timestamp_ntz").alias("sort_ts"), F.col("processed_at").cast("timestamp_ntz").alias("processed_at"),
        F.lit(None).cast("string").alias("skip_reason"), F.lit(None).cast("long").alias("cluster_id"))
    seen, cursor = [], None
    for _ in range(4):
        page = feeds.feed(df, feeds.FeedRequest(limit=2, cursor=cursor)).orderBy("rank").collect()
        seen += [r.id for r in page]
        cursor = page[-1].next_cursor if page else None
        if not cursor:
            break
    assert seen == [6, 5, 4, 3, 2, 1]


def test_feeds_without_state_take_the_default_window(spark):
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    at = lambda s: F.col(s).cast("timestamp").alias(s)
    entries = spark.createDataFrame(
        [(1, "known", "2024-01-09 10:00:00"), (2, "new", "2024-01-09 10:00:00"), (3, "new", "2024-01-07 10:00:00"), (4, "new", None), (5, None, "2024-01-09 10:00:00"), (6, "known", "2024-01-09 13:00:00")],
        "id long, feed_name string, published_at string").select("id", "feed_name", at("published_at"))
    state = spark.createDataFrame([("known", "2024-01-09T12:00:00", 300)], "feed_name string, cursor string, interval_s long")
    assert sorted(r.id for r in ingest.since_cutoff(entries, state, now).collect()) == [2, 4, 5, 6]
    got = {r.feed_name: str(r.new_cursor) for r in ingest.new_cursors(entries, state, now).collect()}
    assert got == {"known": "2024-01-09 13:00:00", "new": "2024-01-09 10:00:00"}


def test_one_story_goes_out_once(spark):
    rows = [(1, 7, 0.9, "2024-01-01 10:05:00"), (2, 7, 0.8, "2024-01-01 10:00:00"), (3, None, 0.9, "2024-01-01 10:00:00"), (4, None, 0.9, "2024-01-01 11:00:00"), (5, 8, 0.1, "2024-01-01 09:00:00"), (6, 8, 0.9, "2024-01-01 12:00:00")]
    df = spark.createDataFrame(rows, "id long, cluster_id long, personal_score double, processed_at string").select(
        "id", "cluster_id", "personal_score", F.col("processed_at").cast("timestamp_ntz").alias("processed_at"), F.lit("f").alias("feed_name"), F.lit("it").alias("vertical"),
        F.lit("rss").alias("source_type"), F.lit(None).cast("timestamp_ntz").alias("pushed_at"), F.lit(None).cast("timestamp_ntz").alias("channel_posted_at"))
    assert sorted(r.id for r in scoring.push_candidates(df).collect()) == [2, 3, 4, 6] == sorted(r.id for r in scoring.channel_candidates(df).collect())


def test_search_brings_no_rows_to_the_driver(spark, monkeypatch):
    v = spark.createDataFrame(list(vector_fixture().items()), "id long, vec array<float>")
    q = v.select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    with monkeypatch.context() as m:
        m.setattr(type(v), "collect", lambda self: pytest.fail("rows collected"))
        found = neighbours.search(q, v, 3, 0.1)
    assert found.count() > 0


def test_search_paths_agree(spark, monkeypatch):
    vecs = vector_fixture()
    v = spark.createDataFrame(list(vecs.items()), "id long, vec array<float>")
    q = v.filter("id < 30").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    shipped = neighbours.search(q, v, 7, 0.1, exclude_self=True).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 10)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 32)
    cut = neighbours.search(q, v, 7, 0.1, exclude_self=True).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id, round(r.cos, 6), r["rank"]) for r in shipped] == [(r.query_id, r.id, round(r.cos, 6), r["rank"]) for r in cut]
    want = brute(vecs, 0.1, 7)
    for qid in range(30):
        assert [round(r.cos, 6) for r in shipped if r.query_id == qid] == pytest.approx([c for _, c in want[qid]], abs=2e-6)


def components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(root)}


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(30)]  # a chain
    edges += [(100, 100 + i) for i in range(1, 60)]  # a hub
    edges += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(45)] + [(5, 5)]
    rng.shuffle(edges)
    got = {r.id: r.component for r in dedup.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == components(edges)


def test_merge_is_stable_under_permutation(spark):
    assigned = [(i, i - i % 2) for i in range(20)]
    links = [(1, 4), (4, 9), (12, 15)]
    results = []
    for flip in (False, True):
        rows = list(reversed(assigned)) if flip else assigned
        n = [(b, a) for a, b in links] if flip else links
        m = dedup.merge_clusters(spark.createDataFrame(rows, "id long, cluster_id long"), spark.createDataFrame(n, "id long, neighbour_id long"))
        results.append(sorted((r.id, r.cluster_id, r["size"]) for r in m.collect()))
    assert results[0] == results[1]
    assert dict((i, c) for i, c, _ in results[0])[9] == 0 and dict((i, s) for i, _, s in results[0])[9] == 6


def clicks_fixture(n=400, seed=1):
    rng = random.Random(seed)
    rows, t = [], T0
    for e in range(n):
        t += timedelta(minutes=rng.choice([0, 1, 30, 200]))
        # one item and signal own more than a third of the log
        item = 1 if rng.random() < 0.5 else rng.randrange(6)
        signal = "up" if rng.random() < 0.6 else rng.choice(["down", "save", "mute_topic", "open"])
        rows.append((e, t, 0, item, signal, f"t{item}" if signal == "mute_topic" else None))
    return rows


CLICKS = "event_id long, ts timestamp_ntz, user_id long, item_id long, signal string, topic string"
ITEMS = "id long, vertical string, tags array<string>, source_type string, feed_name string, author string"
ITEM_ROWS = [(i, ["it", "business", None][i % 3], ["a", f"b{i % 2}"], "rss", f"f{i % 2}", None) for i in range(6)]


def replay(clicks):
    """The log row by row: toggles, weights, likes, mutes."""
    marks, weight, npos, nneg, mutes, actions, liked = set(), {}, {}, {}, set(), {}, {}
    items = {r[0]: r for r in ITEM_ROWS}
    for e, _t, _u, item, signal, topic in sorted(clicks, key=lambda r: (r[1], r[0])):
        key = (item, signal, topic)
        added = key not in marks
        marks.symmetric_difference_update({key})
        actions[e] = "added" if added else "removed"
        vertical, tags = items[item][1], items[item][2]
        if vertical is None:
            continue
        if signal == "mute_topic":
            (mutes.add if added else mutes.discard)((vertical, topic))
        elif signal in ("up", "save", "down"):
            d = (1 if signal != "down" else -1) * (1 if added else -1)
            for tag in tags:
                k = (vertical, tag)
                w = weight.get(k, 0.0)
                weight[k] = max(-1.0, min(1.0, w + 0.1 * (d - w)))
                npos[k] = npos.get(k, 0) + (d > 0)
                nneg[k] = nneg.get(k, 0) + (d < 0)
            if signal != "down":
                liked[vertical] = liked.get(vertical, 0) + (1 if added else -1)
    return marks, weight, npos, nneg, mutes, actions, liked


def test_reaction_log_matches_replay(spark):
    rows = clicks_fixture()
    marks, weight, npos, nneg, mutes, actions, liked = replay(rows)
    ev, items = spark.createDataFrame(rows, CLICKS), spark.createDataFrame(ITEM_ROWS, ITEMS)
    assert {r.event_id: r.action for r in reactions.with_actions(ev).collect()} == actions
    assert {(r.item_id, r.signal, r.topic) for r in reactions.current_marks(ev).collect()} == marks
    aff = {(r.vertical, r.tag): r for r in reactions.tag_affinity(reactions.learning_steps(ev, items)).collect()}
    assert aff.keys() == weight.keys()
    for k, r in aff.items():
        assert r.weight == pytest.approx(weight[k], abs=1e-9) and (r.n_pos, r.n_neg) == (npos[k], nneg[k])
    assert {(r.vertical, r.tag) for r in reactions.learned_mutes(ev, items).collect()} == mutes
    vec = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "id long, vec array<float>")
    taste = {r.vertical: r for r in reactions.taste(reactions.current_marks(ev), items, vec).collect()}
    assert {v: r.n_liked for v, r in taste.items()} == {v: n for v, n in liked.items() if n}
    for v, r in taste.items():
        likes = [m[0] for m in marks if m[1] in ("up", "save") and ITEM_ROWS[m[0]][1] == v]
        assert r.vec == pytest.approx([sum(likes) / len(likes), 1.0])


def test_toggle_twice_is_identity(spark):
    rows = [(0, T0, 0, 1, "up", None), (1, T0, 0, 1, "up", None), (2, T0, 0, 1, "mute_topic", "a"), (3, T0, 0, 1, "mute_topic", "b")]
    left = reactions.current_marks(spark.createDataFrame(rows, CLICKS)).collect()
    assert {(r.signal, r.topic) for r in left} == {("mute_topic", "a"), ("mute_topic", "b")}


def test_running_sum_null_keys(spark):
    rows = [(None, T0 + timedelta(hours=i), i, i + 1) for i in range(5)] + [("k", T0, 9, 7)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, n long, v long")
    got = {r.n: r.s for r in ordered.running_sum(df, ["k"], ["ts", "n"], F.col("v"), "s").collect()}
    assert got == {0: 1, 1: 3, 2: 6, 3: 10, 4: 15, 9: 7}


def test_hot_hours_are_cut_into_seconds(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, "hot", "hot", "b"]), T0 + timedelta(seconds=rng.randrange(7200)), n, rng.choice([-1, 1])) for n in range(400)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, n long, v long")
    seconds = ordered.sliced(df, ["k"], "ts", None, 20)
    sizes = {r["count"] for r in seconds.groupBy("k", "_slice").count().collect()}
    assert max(sizes) <= 20 and seconds.count() == len(rows)
    sums, weights, want = {}, {}, {}
    for k, _, n, v in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        sums[k] = sums.get(k, 0) + v
        weights[k] = weights.get(k, 0.0) * 0.9 + 0.1 * v
        want[n] = sums[k]
    assert {r.n: r.s for r in ordered.running_sum(df, ["k"], ["ts", "n"], F.col("v"), "s", hot_rows=20).collect()} == want
    for r in ordered.decayed_sum(df, ["k"], ["ts", "n"], F.col("v"), 0.1, hot_rows=20).collect():
        assert r.w == pytest.approx(weights[r.k])


def test_apply_profile(spark):
    topics = "array<struct<name:string,polarity:string>>"
    old = spark.createDataFrame([("it", "d", [("keep", "love"), ("turn", "love"), ("gone", "like"), ("gone_learned", "like")])], f"vertical string, description string, topics {topics}")
    new = spark.createDataFrame([("it", " d ", [("keep", "love"), ("turn", "mute"), ("new", "like")])], f"vertical string, description string, topics {topics}")
    aff = spark.createDataFrame([("it", "keep", 0.33, 4, 1), ("it", "turn", 0.9, 2, 0), ("it", "gone", 0.5, 0, 0), ("it", "gone_learned", 0.6, 1, 0)], "vertical string, tag string, weight double, n_pos long, n_neg long")
    got = {r.tag: (r.weight, r.n_pos, r.n_neg) for r in profiles.apply_profile(aff, old, new).collect()}
    assert got == {"keep": (0.33, 4, 1), "turn": (-1.0, 2, 0), "new": (0.5, 0, 0), "gone_learned": (0.6, 1, 0)}
    diff = {(r.kind, r.tag) for r in profiles.declaration_diff(old, new).collect()}
    assert diff == {("changed", "turn"), ("removed", "gone"), ("removed", "gone_learned"), ("added", "new")}
    versions = spark.createDataFrame([("it", 1, "d", []), ("it", 2, "d", []), ("medical", 1, "m", [])], f"vertical string, version int, description string, topics {topics}")
    after = {(r.vertical, r.version): r.active for r in profiles.next_versions(versions, new).collect()}
    assert after == {("it", 1): False, ("it", 2): False, ("it", 3): True, ("medical", 1): True}


def test_gate_precedence(spark):
    rows = [
        (1, "rss", [], [1.0, 0.0], "pass"), (2, "rss", [], [0.0, 1.0], "skip"), (3, "rss", ["Iran"], [0.0, 1.0], "pass"),
        (4, "manual", [], [0.0, 1.0], "pass"), (5, "rss", [], None, "pass"),
    ]
    df = spark.createDataFrame(rows, "id long, source_type string, watch_topics array<string>, vec array<double>, want string")
    prof = spark.createDataFrame([("it", [1.0, 0.0]), ("business", [1.0, 0.0])], "vertical string, vec array<double>")
    got = {r.id: r for r in scoring.gated(df, prof).collect()}
    assert all(r.gate == r.want for r in got.values())
    assert got[2].gate_reason == "низкая близость к профилям: 0.00 (ближе всего business)"
    none = scoring.gated(df, prof.limit(0)).filter("gate = 'skip'").count()
    off = scoring.gated(df, prof, enabled=False).filter("gate = 'skip'").count()
    assert none == 0 and off == 0


def test_watch_boost_is_capped(spark):
    rows = [(1, "it", ["a"], "rss", "f", None, 1.0, ["W"]), (2, "it", ["a"], "rss", "f", None, 0.2, ["W", "Q"]), (3, "it", ["a"], "rss", "f", None, 0.2, ["Q"]), (4, None, ["a"], "rss", "f", None, 0.9, [])]
    df = spark.createDataFrame(rows, ITEMS + ", llm_relevance double, watch_topics array<string>")
    now = F.lit("2024-01-10").cast("timestamp_ntz")
    df = df.withColumns({"vec": F.lit(None).cast("array<double>"), "published_at": now, "skip_reason": F.lit(None).cast("string")})
    aff = spark.createDataFrame([("it", "a", 1.0)], "vertical string, tag string, weight double")
    src = spark.createDataFrame([("it", "rss", "f", 4.0)], "vertical string, source_type string, source_key string, weight double")
    taste = spark.createDataFrame([], "vertical string, n_liked long, vec array<double>")
    muted = spark.createDataFrame([], "vertical string, tag string")
    got = {r.id: r.personal_score for r in scoring.scored(df, aff, src, taste, muted, now, ("Q",)).collect()}
    assert got[1] == 1.0 and got[4] is None
    assert got[2] - got[3] == pytest.approx(0.15)


def test_pages_walk_the_whole_feed(spark, sf_dir):
    items = T.items(spark, sf_dir, clusters=True)
    whole = [r.id for r in feeds.feed(items, feeds.FeedRequest(limit=10_000)).orderBy("rank").collect()]
    # without collapsing, pages chained by cursor give every visible item once
    flat = [r.id for r in feeds.feed(items, feeds.FeedRequest(limit=10_000, collapse=False)).orderBy("rank").collect()]
    seen, cursor = [], None
    while True:
        page = feeds.feed(items, feeds.FeedRequest(limit=60, cursor=cursor, collapse=False)).orderBy("rank").collect()
        seen += [r.id for r in page]
        cursor = page[-1].next_cursor
        if not cursor:
            break
    assert seen == flat and len(whole) < len(flat) and set(whole) <= set(flat)


def test_collapse_limits_rows_before_the_shuffle(spark, sf_dir):
    plan = feeds.collapse(T.items(spark, sf_dir, clusters=True).select("id", "cluster_id", "sort_ts"), feeds.feed_order("recent"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text and "Partial" in text


def test_upsert_twice_is_once(spark):
    cols = "source_type string, source_id string, url string, title string, text string, media array<string>, author string, feed_name string, raw_score double, category string, published_at timestamp, arrival long"
    batch = spark.createDataFrame([("rss", "1", "https://www.e.com/a/?utm_x=1", "old", "t", [], "a" * 300, "f", None, "c", None, 1), ("rss", "1", "https://e.com/a", "new", "t", [], "a", "f", None, "c", None, 2)], cols)
    empty = spark.createDataFrame([], cols.replace(", arrival long", "") + ", id long, url_normalized string, score double, fetched_at timestamp, attempts int")
    now = F.lit("2024-01-01").cast("timestamp")
    once = S.upsert(empty, batch, now)
    row = once.collect()
    assert len(row) == 1 and row[0].title == "new" and row[0].url_normalized == "https://e.com/a" and row[0].was_new
    stored = once.drop("was_new", "touched").withColumn("score", F.lit(0.7))
    again = S.upsert(stored, batch, F.lit("2025-01-01").cast("timestamp")).collect()
    assert len(again) == 1 and not again[0].was_new and again[0].score == 0.7
    assert again[0].id == row[0].id and again[0].fetched_at == row[0].fetched_at
    assert S.prepared(batch).agg(F.max(F.length("author"))).first()[0] == 255


def test_fusion_prefers_agreement_then_first_seen(spark):
    rows = [(1, 0, r, i) for r, i in enumerate([7, 1, 2, 3])] + [(1, 1, r, i) for r, i in enumerate([4, 5, 7, 6])]
    fused = retrieval.fuse(spark.createDataFrame(rows, "query_id long, list_no int, rank int, id long"))
    order = [r.id for r in fused.orderBy(*retrieval.fused_order()).collect()]
    assert order[:3] == [7, 4, 1]



def test_components_around_a_hub(spark):
    """One vertex owns most edges, and not as the smallest one; chains and a second star hang on it."""
    edges = [(500, k) for k in range(1000, 1900)] + [(k, k + 3000) for k in range(1000, 1300)] + [(4000, 4100), (4100, 7), (9001, 9002)]
    edges += [(9500, k) for k in range(9501, 9900)]
    for hub_edges in (10**6, 100):  # without and with hubs
        got = {r.id: r.component for r in dedup.connected_components(spark.createDataFrame(edges, "u long, v long"), hub_edges).collect()}
        assert got == {k: 7 if k < 9001 else 9001 if k < 9003 else 9500 for k in {x for e in edges for x in e}}


def test_grid_forest_connects_what_all_pairs_connect():
    rng = np.random.default_rng(7)
    for shape, share in (((40, 60), 0.02), ((60, 40), 0.3), ((1, 5), 0.5), ((0, 4), 0.5), ((30, 30), 0.0)):
        near = rng.random(shape) < share
        r, c = dedup.grid_forest(near)
        assert near[r, c].all() and len(r) < sum(shape) + 1

        def groups(pairs):
            parent = list(range(sum(shape)))
            for _ in parent:
                for x, y in pairs:
                    parent[x] = parent[shape[0] + y] = min(parent[x], parent[shape[0] + y])
            return parent

        assert groups(list(zip(r.tolist(), c.tolist()))) == groups(list(zip(*(x.tolist() for x in np.nonzero(near)))))


def test_best_keeps_ties_by_id():
    cos = np.array([[0.5, 0.9, 0.9, 0.1], [0.2, 0.2, 0.2, 0.2], [-1.0, 0.3, 0.0, 0.4]])
    ids = np.array([7, 9, 3, 1])
    for k in (1, 2, 3, 9):
        r, c = neighbours._best(cos, ids, k, 0.15)
        want = [(i, j) for i in range(3) for j in sorted(np.flatnonzero(cos[i] >= 0.15), key=lambda j: (-cos[i, j], ids[j]))[:k]]
        assert list(zip(r.tolist(), c.tolist())) == want


def test_stored_index_equals_scoring_everything(spark):
    """Items of very different lengths; a few queries, one without words; fewer postings read than held."""
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choices(vocab, weights=[1 / (i + 1) for i in range(60)], k=n))
    rows = [(i, None if i % 9 == 0 else text(2), text(rng.choice([0, 1, 3, 8, 40, 200])), T0, None) for i in range(900)] + [(900, None, None, T0, None), (901, "w1", "w1", None, None)]
    items = spark.createDataFrame(rows, "id long, title string, text string, processed_at timestamp_ntz, skip_reason string")
    queries = spark.createDataFrame([(1, "w0 w50"), (2, "w3"), (3, "w59 nothing"), (4, "the"), (5, None), (6, "w7 w8 w9 w1")], "query_id long, query string")
    want = {(r.query_id, r.rank): (r.id, round(r.bm25, 9)) for r in retrieval.lexical(queries, items, 10).collect()}
    for size in (5000, 30):
        hits, work = LexicalIndex.build(items, block_items=size).search(queries, 10)
        assert {(r.query_id, r.rank): (r.id, round(r.bm25, 9)) for r in hits.collect()} == want
    assert sum(r.read for r in work.collect()) < sum(r["all"] for r in work.collect())
    assert LexicalIndex.build(items.limit(0)).search(queries, 10)[0].count() == 0


def test_index_of_very_many_lengths(spark):
    """As many bounds of blocks as there may be."""
    visible = ", ".join(f"{n} {t}" for n, t in (("id", "long"), ("title", "string"), ("text", "string"), ("processed_at", "timestamp_ntz"), ("skip_reason", "string")))
    rows = [(i, None, " ".join(["common"] + [f"w{i % 7}"] * i), T0, None) for i in range(1100)]
    items = spark.createDataFrame(rows, visible)
    queries = spark.createDataFrame([(1, "w3 common"), (2, "w6")], "query_id long, query string")
    hits = LexicalIndex.build(items, block_items=1).search(queries, 10)[0]
    want = {(r.query_id, r.rank): (r.id, round(r.bm25, 9)) for r in retrieval.lexical(queries, items, 10).collect()}
    assert len(want) == 20 and {(r.query_id, r.rank): (r.id, round(r.bm25, 9)) for r in hits.collect()} == want


def test_stored_index_writes_no_row_per_posting(spark, tmp_path, monkeypatch):
    """What is kept on the way are rows per item, per term and segment, and per segment and query."""
    rng = random.Random(5)
    rows = [(i, None, " ".join(rng.choices([f"w{j}" for j in range(300)], k=150)), T0, None) for i in range(200)]
    items = spark.createDataFrame(rows, "id long, title string, text string, processed_at timestamp_ntz, skip_reason string")
    queries = spark.createDataFrame([(q, f"w{q} w{q + 9} w{q + 20}") for q in range(30)], "query_id long, query string")
    monkeypatch.setattr(session, "shared_dir", lambda s: str(tmp_path))
    LexicalIndex.build(items, block_items=4).search(queries, 10)[0].count()
    postings = sum(len(set(r[2].split())) for r in rows)
    held = {p.name: spark.read.parquet(str(p)).count() for p in tmp_path.iterdir()}
    assert len(held) > 4 and max(held.values()) < postings / 4, held


def test_stored_index_in_segments(spark, monkeypatch):
    """Many segments and blocks of queries; repeated and missing ids, also of texts of other lengths; repeated and missing query ids."""
    monkeypatch.setattr(lexical_index, "SEGMENT_POSTINGS", 100)
    monkeypatch.setattr(lexical_index, "SCORED_QUERIES", 2)
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(12)}" for _ in range(n))
    rows = [(i if i % 40 else None, text(2), text(rng.choice([0, 1, 5, 30, 90])), T0, None) for i in [*range(300), *range(0, 60, 3), 7, 7]]
    items = spark.createDataFrame(rows + rows[:20], "id long, title string, text string, processed_at timestamp_ntz, skip_reason string")
    queries = spark.createDataFrame([(1, "w1 w2"), (2, "w3"), (2, "w3 w4"), (3, "w11 w0 w5 w6"), (4, "nothing"), (9, "w8"), (5, "w7 w7")], "query_id long, query string")
    want = {(r.query_id, r.rank): (r.id, round(r.bm25, 9)) for r in retrieval.lexical(queries, items, 10).collect()}
    for size in (1, 6, 500):
        index = LexicalIndex.build(items, block_items=size)
        hits, work = index.search(queries.union(spark.createDataFrame([(None, "w1 w2")], queries.schema)), 10)
        assert index.segments > 10
        assert {(r.query_id, r.rank): (r.id, round(r.bm25, 9)) for r in hits.collect()} == want
        assert {r.query_id for r in work.collect()} == {1, 2, 3, 5, 9} and all(0 < r.read <= r["all"] for r in work.collect())


def test_lexical_blocks_equal_brute_force(spark, monkeypatch):
    """Items and queries in many blocks; repeated and missing ids, equal texts, repeated queries."""
    monkeypatch.setattr(retrieval, "SCORED_BLOCK", 7)
    monkeypatch.setattr(retrieval, "SCORED_QUERIES", 2)
    rows = [(i if i % 17 else None, None, " ".join(f"w{(i * j) % 6}" for j in range(2 + i % 4)), T0, None) for i in [*range(60), 5, 6, 6]]
    items = spark.createDataFrame(rows, "id long, title string, text string, processed_at timestamp_ntz, skip_reason string")
    asked = [(1, "w1 w2"), (2, "w3"), (3, "w4 w5 w0"), (4, "nothing"), (1, "w2")]
    df = {w: sum(w in r[2].split() for r in rows) for w in (f"w{i}" for i in range(6))}
    mean = sum(len(r[2].split()) for r in rows) / len(rows)
    want = {}
    for q, words in asked:
        for i, _, text, _, _ in rows:
            for w in set(words.split()) & set(text.split()):
                tf, length = text.split().count(w), len(text.split())
                idf = math.log(1 + (len(rows) - df[w] + 0.5) / (df[w] + 0.5))
                want[q, i] = want.get((q, i), 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))
    best = {q: sorted(((-round(v, 9), i is not None, i or 0) for (p, i), v in want.items() if p == q))[:9] for q in (1, 2, 3)}
    got = retrieval.lexical(spark.createDataFrame(asked, "query_id long, query string"), items, 9).collect()
    assert {(r.query_id, r["rank"]): (r.id, round(r.bm25, 6)) for r in got} == {(q, n): (i if real else None, round(-v, 6)) for q, b in best.items() for n, (v, real, i) in enumerate(b)}


def test_page_search_moves_no_pair_of_question_and_page(spark):
    pages = [("concepts", "solar", "# Solar\n\nsolars and wind"), ("concepts", "solar", "- a solar line"), ("sources", "7-wind", "wind, windy winds"), ("sources", "8-x", None), ("entities", "none", "nothing")]
    asked = [(1, "solar wind"), (2, "wind"), (3, "absent"), (4, None), (2, "wind")]
    found = knowledge.find_pages(spark.createDataFrame(asked, "query_id long, query string"), spark.createDataFrame(pages, "kind string, slug string, piece string"))
    got = {(r.query_id, r["rank"]): (r.kind, r.slug, r.score) for r in found.collect()}
    assert got == {(1, 1): ("concepts", "solar", 7), (1, 2): ("sources", "7-wind", 6), (2, 1): ("sources", "7-wind", 9), (2, 2): ("concepts", "solar", 2)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(kind#" in plan and not re.search(r"hashpartitioning\(query_id#\d+L?, kind#", plan)


def test_words_are_counted_in_bounded_runs():
    words = pa.array([["a", "b", "a", ""], [""], ["c"] * 10 + [""], ["b", ""]] * 5)
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), words], names=["id", "words"]).slice(1)
    whole = list(retrieval._counted(iter([batch])))
    runs = [retrieval._counted_run(batch.slice(a, 3)) for a in range(0, 19, 3)]
    rows = lambda batches: sorted(tuple(r.values()) for b in batches for r in b.to_pylist())
    assert rows(whole) == rows(runs) and (1, 0, "", 1) in rows(whole) and (2, 10, "c", 10) in rows(whole)
    long = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array([["x"] * (retrieval.COUNTED_WORDS // 2) + [""]] * 8)], names=["id", "words"])
    assert len(list(retrieval._counted(iter([long])))) >= 4


def test_cluster_keys_of_any_ids_do_not_meet(spark):
    rows = [(-5, 4, None), (4, 4, T0), (-9, None, T0), (8, None, None), (3, -4, None)]
    items = spark.createDataFrame(rows, "id long, cluster_id long, pushed_at timestamp_ntz")
    assert {r.id: r.cluster_size for r in scoring.with_cluster_size(items).collect()} == {-5: 2, 4: 2, -9: 1, 8: 1, 3: 1}
    assert {r.id: r.cluster_sent for r in scoring.with_cluster_sent(items, "pushed_at").collect()} == {-5: True, 4: False, -9: False, 8: False, 3: False}


def test_a_page_is_bounded():
    assert [feeds.FeedRequest(limit=n).page_size for n in (-3, 0, 1, 50, 200, 10**6)] == [1, 1, 1, 50, 200, 200]
