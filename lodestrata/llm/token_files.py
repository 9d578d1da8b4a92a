"""Token files: equal-length id sequences and masks in Arrow's file format, read by memory map.

Documents are put in order by range partitions; each partition streams its ids, packed end to
end with an end id after each document, into one Arrow file whose record batches hold two
fixed-size lists per row: ids (16 bits where the vocabulary allows, else 32) and a bit mask that
is false on padding. A second file beside it lists the documents. Any sequence is reached
through the file's footer without copying. A task writes files of its own name, so a repeated
task spoils nothing: only files named by the manifest of finished tasks count.

Defined results: a null text counts as empty and gives the end id alone; rows of one doc_id
follow each other by a hash of their texts, repeated rows included; a null doc_id comes first;
an empty table gives no file; extra columns are ignored. A partition's last sequence is padded.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm import pretokens
from lodestrata.llm.common import columns

SEQUENCE = 2048
ROWS = 64
END_ID = 1
MANIFEST = "part int, ids_path string, docs_path string, docs bigint, tokens bigint"


def _file(uri: str):
    filesystem, path = pyarrow.fs.FileSystem.from_uri(uri)
    return filesystem, path


class _Sequences:
    """Streams ids into fixed-size lists, one record batch per full block."""

    def __init__(self, sink, length: int, rows: int, kind: pa.DataType):
        self.length, self.block, self.kind = length, length * rows, kind
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.held, self.size = [], 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.block:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.block * self.block
            for at in range(0, whole, self.block):
                self._write(flat[at:at + self.block], self.block)
            self.held, self.size = [flat[whole:]], len(flat) - whole

    def close(self) -> None:
        if self.size:
            flat = np.concatenate(self.held)
            padded = np.zeros(-(-len(flat) // self.length) * self.length, flat.dtype)
            padded[:len(flat)] = flat
            self._write(padded, len(flat))
        self.writer.close()

    def _write(self, flat: np.ndarray, real: int) -> None:
        ids = pa.array(flat.astype(self.kind.to_pandas_dtype()), self.kind)
        mask = pa.array(np.arange(len(flat)) < real)
        lists = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in (ids, mask)]
        self.writer.write_batch(pa.record_batch(lists, schema=self.schema))


def _writer(folder: str, path: str, length: int, rows: int, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, docs, tokens = TaskContext.get(), 0, 0
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        kind = pa.uint16() if pretokens.tokenizer(path).get_vocab_size() <= 1 << 16 else pa.uint32()
        filesystem, base = _file(folder)
        sequences = listing = None
        end = np.array([end_id], np.uint32)
        for batch in batches:
            if not batch.num_rows:
                continue
            if sequences is None:
                filesystem.create_dir(base, recursive=True)
                ids_sink, docs_sink = (filesystem.open_output_stream(f"{base}/{name}.{x}.arrow") for x in ("ids", "docs"))
                sequences = _Sequences(ids_sink, length, rows, kind)
                listing = pa.ipc.new_file(docs_sink, pa.schema([("doc_id", batch.schema.field("doc_id").type), ("n_tokens", pa.int64())]))
            counts = []
            for _, texts in pretokens.slices(batch.column("text")):
                for ids in pretokens.encode_words(texts, path):
                    sequences.add(ids)
                    sequences.add(end)
                    counts.append(len(ids) + 1)
            listing.write_batch(pa.record_batch([batch.column("doc_id"), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"]))
            docs, tokens = docs + len(counts), tokens + sum(counts)
        if sequences is not None:
            sequences.close()
            listing.close()
            ids_sink.close()
            docs_sink.close()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([context.partitionId()], pa.int32()), "ids_path": [f"{folder}/{name}.ids.arrow"],
                "docs_path": [f"{folder}/{name}.docs.arrow"], "docs": [docs], "tokens": [tokens]})
    return write


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, length: int = SEQUENCE, rows: int = ROWS,
                 end_id: int = END_ID) -> DataFrame:
    """Write all documents in ascending doc_id order; returns the manifest, one row per file.

    ``folder`` is a path or URI that every executor reaches and pyarrow can open.
    """
    target = f"{folder.rstrip('/')}/tokens-{uuid.uuid4().hex}"
    ordered = columns(docs, "doc_id", "text").withColumn("text_key", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "text_key").sortWithinPartitions("doc_id", "text_key")
    made = ordered.select("doc_id", "text").mapInArrow(_writer(f"{target}/files", tokenizer_path, length, rows, end_id), MANIFEST)
    made.write.parquet(f"{target}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{target}/manifest")


def open_ids(uri: str) -> pa.ipc.RecordBatchFileReader:
    """The sequences of a file; a local file is mapped, not read."""
    filesystem, path = _file(uri)
    local = isinstance(filesystem, pyarrow.fs.LocalFileSystem)
    return pa.ipc.open_file(pa.memory_map(path) if local else filesystem.open_input_file(path))


def sequence(reader: pa.ipc.RecordBatchFileReader, k: int, rows: int = ROWS) -> tuple[np.ndarray, pa.Array]:
    """Sequence ``k`` of a file: ids as a view of the file, and its mask."""
    batch = reader.get_batch(k // rows)
    return batch.column("ids")[k % rows].values.to_numpy(zero_copy_only=True), batch.column("mask")[k % rows].values


def _real_ids(reader: pa.ipc.RecordBatchFileReader) -> Iterator[np.ndarray]:
    for k in range(reader.num_record_batches):
        batch = reader.get_batch(k)
        real = pc.sum(batch.column("mask").flatten()).as_py()
        yield batch.column("ids").flatten().to_numpy()[:real]


def _crcs(reader: pa.ipc.RecordBatchFileReader, counts: Iterator[int]) -> Iterator[int]:
    """The crc32 of each document's ids as little-endian 32-bit integers."""
    blocks = _real_ids(reader)
    block = np.zeros(0, np.uint32)
    for count in counts:
        crc = 0
        while count:
            if not len(block):
                block = next(blocks)
            part, block = block[:count], block[count:]
            crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
            count -= len(part)
        yield crc


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            filesystem, path = _file(row["docs_path"])
            start = row["start"]
            with filesystem.open_input_file(path) as source:
                listing = pa.ipc.open_file(source)
                held = [listing.get_batch(k) for k in range(listing.num_record_batches)]
            crcs = _crcs(open_ids(row["ids_path"]), (n for b in held for n in b.column("n_tokens").to_pylist()))
            for b in held:
                counts = b.column("n_tokens").to_numpy()
                starts = start + np.cumsum(counts) - counts
                start += int(counts.sum())
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_id"), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()),
                    pa.array([next(crcs) for _ in counts], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, manifest: DataFrame, doc_id_type: str = "bigint") -> DataFrame:
    """Per document, from the files: start among all ids, number of ids, and their crc32."""
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.withColumn("start", F.coalesce(before, F.lit(0)).cast("long"))
    spread = files.repartition(max(1, min(manifest.count(), 10_000)), "part")
    return spread.select("docs_path", "ids_path", "start").mapInArrow(
        _read, f"doc_id {doc_id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")
