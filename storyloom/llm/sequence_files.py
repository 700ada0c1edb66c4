"""Token ids in Arrow files of equal-length sequences.

A file is Arrow's stream of record batches between two magic numbers, with a footer that names the place of every batch. Its batches
hold the same number of rows, and a row is two fixed-size lists, `ids` (the narrowest unsigned integers that hold the vocabulary) and
`mask` (Arrow's packed booleans, true for an id and false for padding), so sequence i of a file is found by one division and read as a
view of the mapped file: no copy, no decoding. A file beside it lists the documents in order with the place of their first id in the file.

Documents are written in ascending order of their ids. Spark sorts them by range; each range is one file, encoded and written as its
rows stream by, with at most one batch and one text in memory. Only the last sequence of a file is padded. A task writes under a name
of its own and reports it; files of attempts that failed are never listed, so a lost executor costs its tasks only. The list of files
has a row per range and gives each file the number of ids before it. Reading back is a task per file.

Defined results: null and empty texts are the end id alone; null ids come first; rows with equal ids stand in the order of the XXH64
of their texts, so a hot id is spread over ranges; repeated rows are written each; very long texts run over as many sequences as they
need; an empty table gives no files and an empty result; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import bounded_batches, table, with_text
from storyloom.llm.encoding import slices, text_ids
from storyloom.llm.registry import query
from storyloom.session import materialize, scratch_path

LENGTH, ROWS, END_ID = 1024, 64, 2  # ids of a sequence, sequences of a batch, id that ends a document
FILES = "part int, path string, n_docs long, n_ids long"
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
INDEX_ROWS = 4096


def _schema(length: int, largest: int) -> pa.Schema:
    kind = next(t for t, top in ((pa.uint8(), 1 << 8), (pa.uint16(), 1 << 16), (pa.uint32(), 1 << 32)) if largest < top)
    return pa.schema([pa.field("ids", pa.list_(kind, length), nullable=False), pa.field("mask", pa.list_(pa.bool_(), length), nullable=False)])


def _index_path(path: str) -> str:
    return path.removesuffix(".arrow") + ".docs.arrow"


class Writer:
    """One file of sequences and the file of its documents; ids, none above `largest`, are buffered up to a batch."""

    def __init__(self, path: str, length: int, rows: int, largest: int):
        where, name = fs.FileSystem.from_uri(path)
        where.create_dir(name.rpartition("/")[0], recursive=True)
        self.length, self.room, self.schema = length, length * rows, _schema(length, largest)
        self.kind = self.schema.field("ids").type.value_type.to_pandas_dtype()
        self.sinks = [where.open_output_stream(name), where.open_output_stream(_index_path(name))]
        self.out, self.index = pa.ipc.new_file(self.sinks[0], self.schema), pa.ipc.new_file(self.sinks[1], INDEX)
        self.held, self.n_held, self.rows, self.n_docs, self.n_ids = [], 0, [], 0, 0

    def add(self, doc_ids: list, ids: np.ndarray, bounds: np.ndarray) -> None:
        """Documents with their ids, the end id included."""
        self.rows += zip(doc_ids, (self.n_ids + bounds[:-1]).tolist(), np.diff(bounds).tolist())
        self.n_docs, self.n_ids = self.n_docs + len(doc_ids), self.n_ids + len(ids)
        self.held.append(ids.astype(self.kind))
        self.n_held += len(ids)
        if self.n_held >= self.room:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.room * self.room
            for a in range(0, whole, self.room):
                self._batch(flat[a : a + self.room], self.room)
            self.held, self.n_held = [flat[whole:].copy()], len(flat) - whole
        if len(self.rows) >= INDEX_ROWS:
            self._index()

    def _batch(self, flat: np.ndarray, n: int) -> None:
        """The first `n` of these ids are real."""
        mask = np.arange(len(flat)) < n
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, mask)]
        self.out.write_batch(pa.record_batch(lists, schema=self.schema))

    def _index(self) -> None:
        columns = [pa.array(c, pa.int64()) for c in zip(*self.rows)] if self.rows else [pa.array([], pa.int64())] * 3
        self.index.write_batch(pa.record_batch(columns, schema=INDEX))
        self.rows = []

    def close(self) -> None:
        flat = np.concatenate([*self.held, np.zeros(0, self.kind)])
        if len(flat):
            self._batch(np.append(flat, np.zeros(-len(flat) % self.length, self.kind)), len(flat))
        self._index()
        for x in (self.out, self.index, *self.sinks):
            x.close()


class Sequences:
    """Random access to a file's sequences. A local file is mapped and its sequences are views of the map; any other file system is
    read batch by batch at the places that the footer names."""

    def __init__(self, path: str):
        where, name = fs.FileSystem.from_uri(path)
        self.local = isinstance(where, fs.LocalFileSystem)
        self.source = pa.memory_map(name) if self.local else where.open_input_file(name)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        n = self.reader.num_record_batches
        self.rows = self.reader.get_batch(0).num_rows if n else 0
        self.count = self.rows * (n - 1) + self.reader.get_batch(n - 1).num_rows if n else 0
        self.at, self.flat = -1, None

    def __len__(self) -> int:
        return self.count

    def batch(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """The ids of batch k, a row per sequence, and its masks one after the other."""
        if k != self.at:
            b = self.reader.get_batch(k)
            self.flat = b.column(0).flatten().to_numpy(zero_copy_only=True).reshape(-1, self.length), b.column(1).flatten()
            self.at = k
        return self.flat

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """The ids and the mask of sequence i."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        ids, mask = self.batch(i // self.rows)
        at = i % self.rows
        return ids[at], mask.slice(at * self.length, self.length)

    def span(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from `start` on, `n` of them, as views of one batch after the other."""
        room = self.rows * self.length
        while n:
            ids, _ = self.batch(start // room)
            piece = ids.reshape(-1)[start % room : start % room + n]
            yield piece
            start, n = start + len(piece), n - len(piece)


def documents_of(path: str) -> Iterator[pa.RecordBatch]:
    """(doc_id, start, n_tokens) of a file's documents, a batch at a time."""
    where, name = fs.FileSystem.from_uri(_index_path(path))
    with where.open_input_file(name) as source:
        reader = pa.ipc.open_file(source)
        for k in range(reader.num_record_batches):
            yield reader.get_batch(k)


def write_sequences(docs: DataFrame, tokenizer: str, folder: str, length: int = LENGTH, rows: int = ROWS, end_id: int = END_ID) -> DataFrame:
    """(part, path, n_docs, n_ids) of the files written below `folder`; files of a smaller `part` hold smaller ids."""
    bounded_batches(docs.sparkSession)
    keyed = with_text(docs).withColumn("tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, out, part = text_ids(tokenizer), None, TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.arrow"
        for batch in batches:
            for at, texts in slices(batch.column("text")):
                out = out or Writer(path, length, rows, max(end_id, len(encode.tokenizer.bytes) - 1))
                ids, bounds = encode(texts)
                ids = np.insert(ids, bounds[1:], end_id)
                out.add(batch.column("doc_id").slice(at, len(texts)).to_pylist(), ids, bounds + np.arange(len(bounds)))
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "n_docs": [out.n_docs], "n_ids": [out.n_ids]})

    return materialize(ordered.select("doc_id", "text").mapInArrow(run, FILES), "sequence-files")


def read_documents(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files; start counts the ids of all documents before it."""
    spark, rows, before = files.sparkSession, [], 0
    for r in files.orderBy("part").toLocalIterator():  # a row per file
        rows.append((r.path, before))
        before += r.n_ids
    listed = spark.createDataFrame(rows, "path string, before long").repartition(max(1, len(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                source = Sequences(path)
                for docs in documents_of(path):
                    start, n = docs.column("start"), docs.column("n_tokens")
                    sums = []
                    for a, k in zip(start.to_pylist(), n.to_pylist()):
                        crc = 0
                        for piece in source.span(a, k):
                            crc = zlib.crc32(piece.astype("<u4"), crc)
                        sums.append(crc)
                    yield pa.RecordBatch.from_arrays(
                        [docs.column("doc_id"), pa.array(np.asarray(start) + base), n, pa.array(sums, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op13_sequence_files")
def op13_sequence_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return read_documents(write_sequences(docs, byte_vocabulary(), scratch_path(spark, "sequences")))
