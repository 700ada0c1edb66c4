"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "storyloom", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the jobs rely on. On a cluster leave `master` and partition counts to the submit
    command: adaptive execution sizes shuffles from the measured bytes."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return tune(b.getOrCreate())


# The 4.1 union keeps its children's partitioning and fails to plan when a child is a join of two shuffles of different
# sizes; results do not depend on it.
# Keyed state with timers and maps needs the RocksDB store.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.unionOutputPartitioning": "false",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def tune(spark: SparkSession) -> SparkSession:
    """Settings the jobs rely on that can be set on a running session."""
    for k, v in RUNTIME_SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach. A cluster names it in `spark.checkpoint.dir`; only where that is unset and
    the master is local, as in tests, a temporary folder is made and remembered in the session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("storyloom.scratch.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="storyloom-")
        spark.conf.set("storyloom.scratch.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives executor loss."""
    path = scratch_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table of the shared folder that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def spread(df: DataFrame) -> DataFrame:
    """`df` over as many partitions as the setting `storyloom.spread.partitions` says, for steps with much work per row over
    tables in one small file, which Spark reads as one split. Unset, as for tables that have splits enough, `df` is left as
    it is."""
    n = df.sparkSession.conf.get("storyloom.spread.partitions", None)
    return df.repartition(int(n)) if n else df
