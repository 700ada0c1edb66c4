"""Alignment of two tokenizers over the same bytes, by galloping intersection of their token ends.

Both tokenizers' tokens of a text, read as bytes, spell the same string; a token is then an interval that ends at a byte offset. The
shorter of a text's two lists of ends drives: each of its ends gallops in the longer list, by steps that double from where an
earlier end was found and by bisection of the last step, and learns its rank there. Ends found in both lists are common and cut the
text into groups. The ranks of two ends that follow each other also bound the tokens of the longer list that a driving token overlaps, so
links are read off as ranges without comparing tokens. All texts of a slice gallop side by side in numpy: ends that are far apart go
first and give the ends between them their starting points.

How often a pair of ids is linked is counted over the whole corpus: a text's links are summed by pair before they are written, and
by Spark after that. For a text's figures the pairs counted most, at most `HEAD` of them by a cut of the counts at a power of two, are
sent to the tasks; a text's other pairs are joined with the table of counts. Both ways read the same table.

Defined results: texts that are null or empty, or that one of the tokenizers does not spell back (U+2581 becomes a blank), have no
tokens: zeros and an empty digest; repeated rows and ids count each; null ids are kept; very long texts are slices of their own; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import bounded_batches, table
from storyloom.llm.encoding import ByteLevel, Memory, PieceModel, slices, stretches
from storyloom.llm.registry import query
from storyloom.session import materialize

HEAD = 1 << 19  # pairs of ids whose counts are sent to the tasks; the counts of all others are joined
STRIDES = (1024, 32, 1)  # ends of a list that gallop side by side: every 1024th, then every 32nd, then all


def gallop(driver: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """For each end of `driver` the place in `longer` of the first end that is not smaller; both ascend strictly, and the last end of
    `longer` is not smaller than any of `driver`."""
    rank = np.zeros(len(driver), dtype=np.int64)
    done = None
    for stride in STRIDES:
        here = np.arange(0, len(driver), stride)
        start = np.zeros(len(here), dtype=np.int64) if done is None else rank[here // done * done]
        rank[here] = _gallop_from(driver[here], longer, start)
        done = stride
    return rank


def _gallop_from(wanted: np.ndarray, longer: np.ndarray, low: np.ndarray) -> np.ndarray:
    """`low` is not beyond the place that is sought."""
    low, last = low.copy(), len(longer) - 1
    rank = low.copy()
    go = np.flatnonzero(longer[low] < wanted) if len(longer) else np.zeros(0, np.int64)
    high, step, active = low.copy(), 1, go
    while len(active):  # exponential: longer[low] < wanted always
        at = np.minimum(low[active] + step, last)
        short = longer[at] < wanted[active]
        high[active[~short]] = at[~short]
        low[active[short]] = at[short]
        active, step = active[short], step * 2
    while len(go):  # bisection: longer[low] < wanted <= longer[high]
        go = go[high[go] - low[go] > 1]
        mid = (low[go] + high[go]) >> 1
        short = longer[mid] < wanted[go]
        low[go[short]] = mid[short]
        high[go[~short]] = mid[~short]
    return np.where(high > rank, high, rank)


class Aligned(NamedTuple):
    """Tokens of several texts, one text after the other, and how they meet. `first` and `rank` bound, for every driving token, the
    overlapping tokens among the longer lists."""

    driver_rows: np.ndarray  # offsets of the texts among the driving tokens
    longer_rows: np.ndarray
    first: np.ndarray
    rank: np.ndarray
    common: np.ndarray  # whether a driving token ends where a token of the longer list ends
    of_a: np.ndarray  # whether the driving tokens of a text are those of A
    place_a: np.ndarray  # places of A's tokens among the driving or the longer ones
    place_b: np.ndarray


def align(ends_a: np.ndarray, rows_a: np.ndarray, ends_b: np.ndarray, rows_b: np.ndarray) -> Aligned:
    """Ends are counted through all texts, and each text's last ends are equal, so one walk serves all texts."""
    n_a, n_b = np.diff(rows_a), np.diff(rows_b)
    of_a = n_a <= n_b
    driver_rows = np.append(0, np.cumsum(np.where(of_a, n_a, n_b)))
    longer_rows = np.append(0, np.cumsum(np.where(of_a, n_b, n_a)))
    driver, longer = np.zeros(driver_rows[-1], dtype=np.int64), np.zeros(longer_rows[-1], dtype=np.int64)
    places = []
    for ends, rows, n, drives in ((ends_a, rows_a, n_a, of_a), (ends_b, rows_b, n_b, ~of_a)):
        base = np.where(drives, driver_rows[:-1], longer_rows[:-1])
        place = np.arange(len(ends)) + np.repeat(base - rows[:-1], n)
        mine = np.repeat(drives, n)
        driver[place[mine]], longer[place[~mine]] = ends[mine], ends[~mine]
        places.append(place)
    rank = gallop(driver, longer)
    common = longer[rank] == driver if len(driver) else np.zeros(0, dtype=bool)
    # the token after a common end begins a new range; any other shares the token its predecessor ended in
    first = np.append(0, rank[:-1] + common[:-1]) if len(rank) else rank
    return Aligned(driver_rows, longer_rows, first, rank, common, of_a, *places)


class Aligner:
    """Works on Arrow arrays of texts; one per Python worker."""

    def __init__(self, byte_level: str, pieces: str):
        self.a, self.b = ByteLevel(byte_level, plain=True), PieceModel(pieces)
        self.cut = self.a.cuts and self.b.cuts
        self.memory = Memory(self.a, self.b)
        # a token's digits and the mark behind it: inside its side of a group, at the end of it
        marks = [(len(self.a.bytes), ",|"), (len(self.b.bytes), ",;")]
        self.shown = pa.array([f"{i}{m}" for n, both in marks for i in range(n) for m in both])

    def batch(self, texts: pa.Array) -> pa.RecordBatch:
        n = len(texts)
        blank = pc.equal(pc.binary_length(texts), 0)
        led = pc.if_else(blank, "", pc.binary_join_element_wise("", texts, " "))
        s = stretches(led, self.cut)
        numbers = self.memory(s.vocab)[s.codes]
        owner = np.repeat(np.arange(n), np.diff(s.offsets))
        whole = np.ones(n, dtype=bool)
        whole[owner[~self.memory.spelt[numbers]]] = False
        numbers, offsets = numbers[whole[owner]], np.append(0, np.cumsum(np.where(whole, np.diff(s.offsets), 0)))
        ids_a, cut_a = self.memory.strung(0, numbers)
        ids_b, cut_b = self.memory.strung(1, numbers)
        rows_a, rows_b = np.append(0, cut_a)[offsets], np.append(0, cut_b)[offsets]
        met = align(np.cumsum(self.a.sizes[ids_a]), rows_a, np.cumsum(self.b.sizes[ids_b]), rows_b)
        n_a, n_b = np.diff(rows_a), np.diff(rows_b)
        found = np.append(0, np.cumsum(met.common))[met.driver_rows]
        links = np.append(0, np.cumsum(met.rank - met.first + 1))
        pairs, times, bounds = self._pairs(ids_a, ids_b, met, links)
        lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x)) for x in (pairs, times.astype(np.int32))]
        return pa.RecordBatch.from_arrays(
            [*(pa.array(x) for x in (n_a, n_b, np.diff(found), np.diff(links[met.driver_rows]))),
             pa.array(self._digests(ids_a, ids_b, rows_a, rows_b, met)), *lists],
            names=["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    def _pairs(self, ids_a: np.ndarray, ids_b: np.ndarray, met: Aligned, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct pairs of ids of every text, as a * |B| + b, how often each is linked there, and the offsets of the texts."""
        n_driver = np.diff(met.driver_rows)
        driver, longer = np.zeros(met.driver_rows[-1], dtype=np.int64), np.zeros(met.longer_rows[-1], dtype=np.int64)
        for ids, place, drives, rows in ((ids_a, met.place_a, met.of_a, met), (ids_b, met.place_b, ~met.of_a, met)):
            mine = np.repeat(drives, np.where(drives, n_driver, np.diff(met.longer_rows)))
            driver[place[mine]], longer[place[~mine]] = ids[mine], ids[~mine]
        owner = np.repeat(np.arange(len(driver)), np.diff(links))
        other = longer[met.first[owner] + np.arange(links[-1]) - links[owner]]
        row = np.repeat(np.arange(len(n_driver)), n_driver)[owner]
        a_first = met.of_a[row]
        own = driver[owner]
        width = len(self.b.bytes)
        room = width * len(self.a.bytes)
        keys, times = np.unique(row * room + np.where(a_first, own, other) * width + np.where(a_first, other, own), return_counts=True)
        return keys % room, times, np.searchsorted(keys, np.arange(len(n_driver) + 1) * room)

    def _digests(self, ids_a: np.ndarray, ids_b: np.ndarray, rows_a: np.ndarray, rows_b: np.ndarray, met: Aligned) -> list[str]:
        """The digest of every text's groups; tokens are strung together in the order of groups, A's before B's."""
        n = np.diff(met.driver_rows)
        last_driver, last_longer = met.common, np.zeros(met.longer_rows[-1], dtype=bool)
        last_longer[met.rank[met.common]] = True
        drives_a, drives_b = np.repeat(met.of_a, np.diff(rows_a)), np.repeat(~met.of_a, np.diff(rows_b))
        last_a, last_b = np.zeros(len(ids_a), dtype=bool), np.zeros(len(ids_b), dtype=bool)
        for last, drives, place in ((last_a, drives_a, met.place_a), (last_b, drives_b, met.place_b)):
            last[drives], last[~drives] = last_driver[place[drives]], last_longer[place[~drives]]
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        upto_a, upto_b = np.append(np.flatnonzero(last_a) + 1, 0), np.append(0, np.flatnonzero(last_b) + 1)
        order = np.zeros(len(ids_a) + len(ids_b), dtype=np.int64)
        order[np.arange(len(ids_a)) + upto_b[group_a]] = 2 * ids_a + last_a
        order[np.arange(len(ids_b)) + upto_a[group_b]] = 2 * (len(self.a.bytes) + ids_b.astype(np.int64)) + last_b
        strung = self.shown.take(pa.array(order))
        if not len(strung):
            return [""] * len(n)
        at = np.frombuffer(strung.buffers()[1], dtype=np.int32)[: len(strung) + 1]
        data, bounds = memoryview(strung.buffers()[2]), at[rows_a + rows_b].tolist()
        return [hashlib.sha256(data[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(bounds, bounds[1:])]


@functools.cache
def aligner_of(byte_level: str, pieces: str) -> Aligner:
    """One per Python worker, which serves many tasks."""
    return Aligner(byte_level, pieces)


SHAPE = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def aligned(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """A row per document: its figures, and its distinct pairs of linked ids with their numbers; `part` and `nth` name the row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, part, nth = aligner_of(byte_level, pieces), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at, texts in slices(batch.column("text")):
                out, n = aligner.batch(texts), len(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, n), pa.array(np.full(n, part, dtype=np.int32)), pa.array(nth + np.arange(n)), *out.columns],
                    names=["doc_id", "part", "nth", *out.schema.names])
                nth += n

    text = F.coalesce("text", F.lit("")).alias("text")
    return docs.select("doc_id", text).mapInArrow(run, f"doc_id long, part int, nth long, {SHAPE}")


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): links of every pair of ids over all documents, and whether its B id has no pair with more."""
    counts = materialize(
        rows.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n")), "pair-counts")
    b = F.pmod("pair", F.lit(width)).alias("b")
    most = counts.groupBy(b).agg(F.max("n").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(rows: DataFrame, counts: DataFrame, head: int = HEAD) -> DataFrame:
    """`rows` plus `n_best` and `count_sum`; `counts(pair, n, best)` has a row for every pair."""
    spark = rows.sparkSession
    level, least = F.floor(F.log2("n")).cast("int"), 64
    sizes = {r.level: r.c for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("c")).collect()}  # at most 64 rows
    room = head
    for k in sorted(sizes, reverse=True):
        room -= sizes[k]
        if room < 0:
            break
        least = k
    top = counts.filter(level >= least).toPandas().sort_values("pair")  # at most `head` rows
    sent = spark.sparkContext.broadcast(tuple(top[c].to_numpy() for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = sent.value
        best = best.astype(bool)
        for batch in batches:
            lists = batch.column("pairs")
            bounds = np.asarray(lists.offsets, dtype=np.int64)
            pairs = np.asarray(lists.values)[bounds[0] : bounds[-1]]
            times = np.asarray(batch.column("times").values)[bounds[0] : bounds[-1]].astype(np.int64)
            bounds = bounds - bounds[0]
            if len(keys):
                at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
                known = keys[at] == pairs
                sums = np.where(known, n[at], 0) * times, np.where(known & best[at], times, 0)
            else:
                known, sums = np.zeros(len(pairs), dtype=bool), (np.zeros(len(pairs), dtype=np.int64),) * 2
            left = np.append(0, np.cumsum(~known))[bounds]
            totals = [np.diff(np.append(0, np.cumsum(x))[bounds]) for x in sums]
            rest = [pa.ListArray.from_arrays(pa.array(left, pa.int32()), pa.array(x[~known])) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(x) for x in totals), *rest],
                                             names=[*names, "count_sum", "n_best", "rest", "rest_times"])

    names = ["doc_id", "part", "nth", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = "doc_id long, part int, nth long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    known = materialize(
        rows.select(*names, "pairs", "times").mapInArrow(run, schema + "count_sum long, n_best long, rest array<long>, rest_times array<long>"),
        "known-links")
    sent.destroy()
    rest = known.select("part", "nth", F.inline(F.arrays_zip("rest", "rest_times"))).join(counts.withColumnRenamed("pair", "rest"), "rest")
    sums = rest.groupBy("part", "nth").agg(
        F.sum(F.col("rest_times") * F.col("n")).alias("more"), F.sum(F.when(F.col("best"), F.col("rest_times")).otherwise(0)).alias("more_best"))
    more = known.drop("rest", "rest_times").join(sums, ["part", "nth"], "left")
    return more.withColumn("count_sum", F.col("count_sum") + F.coalesce("more", F.lit(0))).withColumn(
        "n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).drop("more", "more_best", "part", "nth")


def cross_aligned(docs: DataFrame, byte_level: str, pieces: str, head: int = HEAD) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, count_sum, n_best) of every document."""
    rows = materialize(aligned(docs, byte_level, pieces), "alignments")
    counts = materialize(pair_counts(rows, len(PieceModel(pieces).bytes)), "pair-counts")
    return with_counts(rows, counts, head)


def vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@query("op11_tokenizer_alignment")
def op11_tokenizer_alignment(spark, sf_dir):
    out = cross_aligned(table(spark, sf_dir, "documents", "doc_id", "text"), *vocabularies())
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
