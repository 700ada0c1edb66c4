"""Registered queries against their SQL twins. A selection by default; ORACLE_ALL=1 runs all of them."""

from __future__ import annotations

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, rows_of

QUICK = [
    "a2_incremental_cutoff", "a7_upsert", "b4_detect_lang", "b19_url_shapes", "c6_push_candidates", "c11_retry_backlog", "d1_url_clusters",
    "d10_tag_current_vs_base", "d12_cluster_sent", "e1_trends_month", "e4_group_counts", "e7_taste_centroid", "f6_refine_triggers",
    "g1_recent_feed", "g2_keyset_page", "g8_windowed_top", "g15_apply_profile", "h3_lexical", "h6_hybrid_search", "h13_wiki_search",
    "j4_streaming_learner", "j4_taste", "j4_refine_triggers", "j7_late_window", "j8_silence_stream", "j8_stall_alerts", "j8_stall_stream",
]
NAMES = sorted(oracle_sql()) if os.environ.get("ORACLE_ALL") else QUICK


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, sf_dir, name):
    df = queries()[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(oracle_sql()[name])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0


def test_names_and_twins():
    assert set(oracle_sql()) <= set(queries())
    assert len(queries()) > 130
