from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from storyloom.session import build_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session(
        "tests", "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture
def apply(spark):
    """Evaluate a column function on a list of rows: apply(fn, rows, schema) -> list of values."""
    from pyspark.sql import functions as F

    def run(fn, rows, schema="x string"):
        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_i int, " + schema)
        cols = [F.col(c) for c in df.columns[1:]]
        return [r.v for r in df.select("_i", fn(*cols).alias("v")).orderBy("_i").collect()]

    return run
