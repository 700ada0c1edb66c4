"""Tables with one row per key that a stream keeps up to date, for jobs that would otherwise read their history again.

Rows lie in buckets by a hash of their key. A micro-batch reads the buckets that its keys fall into, merges, and writes those
buckets anew under its batch id; a small list, put in place by one rename, says which version of each bucket is the current one. A repeated batch
starts from the list of the batch before it and writes the same files again, so every batch counts once. Versions that
neither of the last two lists names are removed, so the table stays as large as its rows. Rows whose keys are new may be appended: they
are written beside what their buckets hold, and a bucket is the sum of several versions until it has `PARTS` of them.

What a batch brings must be reduced to one row per key first, by operators that spread hot keys; merging is then a join on the key.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 8  # for tables that stay small; give more where a bucket would be rewritten slowly
PARTS = 16  # versions that a bucket may consist of before an append makes them one


def _parts(version: int | list[int]) -> list[int]:
    """The batches that wrote a bucket: one, or those whose rows were appended as well."""
    return version if isinstance(version, list) else [version]


def matched(old: DataFrame, new: DataFrame, keys: list[str], how: str = "full_outer") -> DataFrame:
    """The keys of either side, with the other columns as the structs `old` and `new`, NULL where a side has no row."""
    o = old.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.struct(*[c for c in old.columns if c not in keys]).alias("old"), F.lit(True).alias("_o"))
    n = new.select(*[F.col(k).alias(f"_n_{k}") for k in keys], F.struct(*[c for c in new.columns if c not in keys]).alias("new"), F.lit(True).alias("_n"))
    same = reduce(lambda x, y: x & y, [F.col(f"_o_{k}").eqNullSafe(F.col(f"_n_{k}")) for k in keys])
    key = [F.when(F.col("_n").isNotNull(), F.col(f"_n_{k}")).otherwise(F.col(f"_o_{k}")).alias(k) for k in keys]
    return o.join(n, same, how).select(*key, F.when(F.col("_o"), F.col("old")).alias("old"), F.when(F.col("_n"), F.col("new")).alias("new"))


class KeyedTable:
    """One row per key of `keys`. `schema` is a DDL string or a StructType that holds the keys; every column of it is kept. Buckets are
    by all keys, or by those of `bucket_by`, so that rows which share them are found together."""

    def __init__(
        self, spark: SparkSession, path: str, schema: str | StructType, keys: list[str], buckets: int = BUCKETS, bucket_by: list[str] | None = None
    ) -> None:
        self.spark, self.path, self.keys, self.bucket_by = spark, path.rstrip("/"), keys, bucket_by or keys
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.columns = [f.name for f in self.schema.fields]
        self.fs, self.root = fs.FileSystem.from_uri(self.path)
        self.buckets = buckets
        known = self._versions()
        if known:  # the number of buckets is fixed when the table is made
            self.buckets = self._listed(known[-1])["buckets"]

    # the lists of versions: bucket -> batch that wrote it, or batches whose rows it has

    def _list_path(self, batch_id: int) -> str:
        return f"{self.root}/versions/{batch_id}.json"

    def _versions(self) -> list[int]:
        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/versions", allow_not_found=True))
        return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json"))

    def _listed(self, batch_id: int) -> dict:
        with self.fs.open_input_stream(self._list_path(batch_id)) as f:
            return json.loads(f.read())

    def _current(self, before: int | None) -> dict[str, int | list[int]]:
        known = [v for v in self._versions() if before is None or v < before]
        return self._listed(known[-1])["versions"] if known else {}

    def _commit(self, batch_id: int, versions: dict[str, int | list[int]]) -> None:
        self.fs.create_dir(f"{self.root}/versions", recursive=True)
        draft = f"{self.root}/versions/{batch_id}.draft"
        with self.fs.open_output_stream(draft) as f:
            f.write(json.dumps({"buckets": self.buckets, "versions": versions}).encode())
        self.fs.move(draft, self._list_path(batch_id))

    def _drop_old(self) -> None:
        """Files that neither the current list nor the one before it (from which a batch may be repeated) names."""
        known = self._versions()
        old, kept = known[:-2], [self._listed(v)["versions"] for v in known[-2:]]
        named = {(b, v) for k in kept for b, vs in k.items() for v in _parts(vs)}
        for batch_id in old:
            for b, v in [(b, v) for b, vs in self._listed(batch_id)["versions"].items() for v in _parts(vs)]:
                if (b, v) not in named:
                    folder = f"{self.root}/data/v={v}/bucket={b}"
                    if self.fs.get_file_info(folder).type == fs.FileType.Directory:
                        self.fs.delete_dir(folder)
            self.fs.delete_file(self._list_path(batch_id))

    # rows

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int")

    def _rows(self, versions: dict[str, int | list[int]]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/v={v}/bucket={b}" for b, vs in sorted(versions.items()) for v in _parts(vs)])

    def read(self, before: int | None = None) -> DataFrame:
        """All rows, as they are now or as they were before a batch. A version stays readable until two later ones are written."""
        return self._rows(self._current(before))

    def _touched(self, rows: DataFrame) -> list[str]:
        return [str(r.b) for r in rows.select(self._bucket().alias("b")).distinct().collect()]  # at most `buckets` numbers

    def near(self, rows: DataFrame, before: int | None = None) -> DataFrame:
        """The rows of the buckets that the keys of `rows` fall into; no other bucket is read."""
        known = self._current(before)
        return self._rows({b: known[b] for b in self._touched(rows) if b in known})

    def found(self, rows: DataFrame, before: int | None = None) -> DataFrame:
        """`rows` with the row of their key as the struct `old`, NULL for unknown keys."""
        o = self.near(rows, before)
        o = o.select(*[F.col(k).alias(f"_o_{k}") for k in self.keys], F.struct(*[c for c in self.columns if c not in self.keys]).alias("old"))
        same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in self.keys])
        return rows.join(o, same, "left").drop(*[f"_o_{k}" for k in self.keys])

    def unknown(self, rows: DataFrame, before: int | None = None) -> DataFrame:
        """`rows` whose key is not in the table; of the table only the keys are read."""
        o = self.near(rows, before).select(*[F.col(k).alias(f"_o_{k}") for k in self.keys])
        return rows.join(o, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in self.keys]), "left_anti")

    def _write(self, rows: DataFrame, batch_id: int) -> set[str]:
        """Write `rows` as the version `batch_id` of their buckets, which are returned; a large bucket is written by several tasks."""
        to = f"{self.path}/data/v={batch_id}"
        rows.select(*self.columns).withColumn("bucket", self._bucket()).hint("rebalance", "bucket").write.partitionBy("bucket").mode("overwrite").parquet(to)
        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/data/v={batch_id}"))
        return {f.base_name.removeprefix("bucket=") for f in found if f.type == fs.FileType.Directory and f.base_name.startswith("bucket=")}

    def append(self, rows: DataFrame, batch_id: int, keys_of: DataFrame) -> None:
        """Bring `rows`, whose keys are not in the table, into it. Rows that are there already are neither read nor written, but in
        buckets of `PARTS` versions, which become one. `keys_of` names a table with the same keys."""
        known = self._current(batch_id)
        full = {b: known[b] for b in self._touched(keys_of) if b in known and len(_parts(known[b])) >= PARTS}
        written = self._write(self._rows(full).unionByName(rows.select(*self.columns)) if full else rows, batch_id)
        kept = {b: v for b, v in known.items() if b not in full}
        self._commit(batch_id, kept | {b: [*_parts(kept[b]), batch_id] if b in kept else batch_id for b in written})
        self._drop_old()

    def merge(
        self, rows: DataFrame, batch_id: int, changed: dict[str, Column] | Callable[[DataFrame, DataFrame], DataFrame], keys_of: DataFrame | None = None
    ) -> None:
        """Bring `rows`, one per key, into the table. `changed` gives the new value of each column beside the keys from the structs
        `old` and `new`, either of which may be NULL; or it makes all rows of the touched buckets from the old ones and `rows`. Where
        `rows` are dear to compute, `keys_of` names a table with the same keys."""
        known = self._current(batch_id)
        touched = self._touched(rows if keys_of is None else keys_of)
        old = self._rows({b: known[b] for b in touched if b in known})
        if callable(changed):
            out = changed(old, rows)
        else:
            out = matched(old, rows, self.keys).select(*self.keys, *[v.alias(k) for k, v in changed.items()])
        written = self._write(out, batch_id)
        self._commit(batch_id, {b: v for b, v in known.items() if b not in touched} | {b: batch_id for b in written})
        self._drop_old()
