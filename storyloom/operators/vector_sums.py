"""Weighted sums of vectors per key: each Arrow batch is summed in numpy, and only one vector per key and batch is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _groups(columns: list[pa.Array], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each group, group of each row) for rows with equal values in all columns, NULLs being equal."""
    code = np.zeros(n, dtype=np.int64)
    for col in columns:
        coded = col.dictionary_encode()
        code = code * (len(coded.dictionary) + 1) + np.asarray(pc.fill_null(coded.indices, -1), dtype=np.int64) + 1
        code = np.unique(code, return_inverse=True)[1]
    _, first, group = np.unique(code, return_index=True, return_inverse=True)
    return first, group


def vector_sums(rows: DataFrame, keys: list[str], vec: str, weight: str) -> DataFrame:
    """(keys..., n, total): the sum of `weight` and, per place, the sum of `weight` times the vector. Vectors may differ in length;
    the sums of a place are over the vectors that have it, and `n` is that of the first place."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.asarray(pc.list_value_length(b.column(vec)), dtype=np.int64)
            flat = np.asarray(pc.fill_null(b.column(vec).flatten(), 0.0), dtype=np.float64)
            times = np.asarray(b.column(weight), dtype=np.int64)
            begin = np.cumsum(sizes) - sizes
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                at = pa.array(own)
                first, group = _groups([b.column(k).take(at) for k in keys], len(own))
                total, n = np.zeros((len(first), size)), np.zeros(len(first), dtype=np.int64)
                np.add.at(total, group, flat[begin[own][:, None] + np.arange(size)] * times[own][:, None])
                np.add.at(n, group, times[own])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1) * size, pa.int32()), pa.array(total.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(own[first])) for k in keys), pa.array(n), lists], names=[*keys, "_n", "_total"])

    usable = rows.filter(F.col(vec).isNotNull() & (F.size(vec) > 0)).select(*keys, F.col(vec).cast("array<double>").alias(vec), F.col(weight).cast("long").alias(weight))
    parts = usable.mapInArrow(run, f"{fields}, _n long, _total array<double>")
    sums = parts.select(*keys, "_n", F.posexplode("_total").alias("_pos", "_v")).groupBy(*keys, "_pos").agg(F.sum("_v").alias("_s"), F.sum("_n").alias("_m"))
    whole = sums.groupBy(*keys).agg(F.max_by("_m", -F.col("_pos")).alias("n"), F.sort_array(F.collect_list(F.struct("_pos", "_s"))).alias("_ps"))
    return whole.select(*keys, "n", F.transform("_ps", lambda p: p["_s"]).alias("total"))
