"""Token ids in Arrow files: batches of fixed-size lists, so that a memory map gives any sequence and its mask without a copy.

One pair of files for each range of document ids. `*.ids.arrow` has rows (ids: list of L, mask: list of L), the range's
documents end to end, the last row padded (mask 0). `*.docs.arrow` has (doc_id, start, n_tokens), start counted from
the file's first id. Files are named by task attempt and count only once the manifest names them, so a task that is lost
and run again leaves at most an unread file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import pick
from colloquy.llm.tokens import encoder

SEQUENCE = 2048
ROWS_PER_BATCH = 256
MANIFEST = "part bigint, file string, n_tokens bigint"
PER_DOC = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def opened(path: str):
    """The file system and the plain path of a local path or URI."""
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


class SequenceWriter:
    """Fills rows of equal length with ids and writes them in batches of bounded size."""

    def __init__(self, filesystem, path: str, length: int, width: str) -> None:
        self.length, self.width = length, np.dtype(width)
        kind = pa.from_numpy_dtype(self.width)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.uint8(), length))])
        self.sink = filesystem.open_output_stream(path)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.parts, self.waiting, self.total = [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids.astype(self.width))
        self.waiting += len(ids)
        self.total += len(ids)
        whole = self.length * ROWS_PER_BATCH
        if self.waiting >= whole:
            self._flush(self.waiting // whole * whole)

    def _flush(self, take: int) -> None:
        flat = np.concatenate(self.parts) if self.parts else np.zeros(0, self.width)
        self.parts, self.waiting = [flat[take:]], len(flat) - take
        for at in range(0, take, self.length * ROWS_PER_BATCH):
            part = flat[at:min(take, at + self.length * ROWS_PER_BATCH)]
            real = len(part)
            padded = np.pad(part, (0, -real % self.length))
            mask = (np.arange(len(padded)) < real).view(np.uint8)  # a byte each, so that a map is a mask
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (padded, mask)]
            self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.waiting:
            self._flush(self.waiting)
        self.file.close()
        self.sink.close()


def write_ids(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, length: int = SEQUENCE, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Encode every whole text, end it with `end_id`, write the ids in ascending doc_id order; return the manifest.

    `folder` is one that all executors share. The manifest (part, file, n_tokens), a file's row each, is written below it
    and read back; that runs the job. Texts are dealt out by ranges of (doc_id, hash of the text), so many rows of one id
    do not meet in one task. Null texts are empty and null ids come first; an empty table gives no file; other columns
    are ignored. Ids take two bytes where the vocabulary allows it.
    """
    from tokenizers import Tokenizer

    vocabulary = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1)
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, writer = encoder(tokenizer_path), TaskContext.get(), None
        filesystem, plain = opened(folder)
        name = f"{task.partitionId():08d}-{task.taskAttemptId()}"
        index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                writer = SequenceWriter(filesystem, f"{plain}/{name}.ids.arrow", length, width)
                docs_sink = filesystem.open_output_stream(f"{plain}/{name}.docs.arrow")
                docs_file = pa.ipc.new_file(docs_sink, index)
            for at, ids, ends in encode.encode(batch.column("text")):
                counts = np.diff(ends, prepend=0) + 1
                starts = writer.total + np.cumsum(counts) - counts
                writer.add(np.insert(ids, ends, end_id))  # a text's end id stands behind its ids
                docs_file.write_batch(pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(ends)), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=index))
        if writer is not None:
            writer.close()
            docs_file.close()
            docs_sink.close()
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([task.partitionId()], pa.int64()), "file": [name], "n_tokens": pa.array([writer.total], pa.int64())})

    filesystem, plain = opened(folder)
    filesystem.create_dir(plain, recursive=True)
    rows = pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    `ids_crc32` is the checksum of the ids as little-endian unsigned 32-bit integers. Each task maps whole files and holds
    one document's ids at a time. The running sum over the manifest has one row for each file.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, plain = opened(folder)
        local = isinstance(filesystem, fs.LocalFileSystem)

        def arrow(path: str) -> pa.ipc.RecordBatchFileReader:
            return pa.ipc.open_file(pa.memory_map(path) if local else filesystem.open_input_file(path))

        for batch in batches:
            for file, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist()):
                ids, index = arrow(f"{plain}/{file}.ids.arrow"), arrow(f"{plain}/{file}.docs.arrow")
                length, at, base, values = ids.schema.field("ids").type.list_size, -1, 0, np.zeros(0)
                for i in range(index.num_record_batches):
                    docs = index.get_batch(i)
                    sums = []
                    for start, n in zip(docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist()):
                        crc = 0
                        while n:
                            while start >= base + len(values):
                                base, at = base + len(values), at + 1
                                values = ids.get_batch(at).column("ids").flatten().to_numpy()
                            part = values[start - base:start - base + n]
                            crc = zlib.crc32(part.astype("<u4"), crc)
                            start, n = start + len(part), n - len(part)
                        sums.append(crc)
                    yield pa.RecordBatch.from_arrays(
                        [docs.column("doc_id"), pc.add(docs.column("start"), before), docs.column("n_tokens"), pa.array(sums, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"])

    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("file", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("before"))
    return placed.repartition(max(1, manifest.count())).mapInArrow(read, PER_DOC)


def sequence(folder: str, file: str, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of one sequence of a file; on a memory-mapped file both are views, not copies."""
    filesystem, plain = opened(folder)
    path = f"{plain}/{file}.ids.arrow"
    reader = pa.ipc.open_file(pa.memory_map(path) if isinstance(filesystem, fs.LocalFileSystem) else filesystem.open_input_file(path))
    batch = reader.get_batch(row // ROWS_PER_BATCH)
    ids, mask = (batch.column(c)[row % ROWS_PER_BATCH].values for c in ("ids", "mask"))
    return ids.to_numpy(), mask.to_numpy().view(np.bool_)
