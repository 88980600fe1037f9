"""Operator 3, token-ID output: Arrow files of fixed-size-list batches, equal-length sequences and masks without a copy."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_type, partitions, shared_dir, small_batches, table, texts_of
from .vocab import Vocabulary

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
MANIFEST = "shard int, path string, n_ids long, n_docs long"
#: Sequences in one record batch of a file, and documents that are encoded at once.
BATCH, ENCODED = 256, 128


def _open(path: str, write: bool):
    fs, inner = pyarrow.fs.FileSystem.from_uri(path)
    if write:
        fs.create_dir(inner.rpartition("/")[0], recursive=True)
        return fs, inner, fs.open_output_stream(inner)
    return fs, inner, pa.memory_map(inner) if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file(inner)


class _Shard:
    """One file of sequences and one of document bounds, written as the documents come; nothing but a batch is held."""

    def __init__(self, path: str, length: int, kind: pa.DataType):
        self.path, self.length, self.kind, self.dtype = path, length, kind, kind.to_pandas_dtype()
        if length % 8:
            raise ValueError("length must be a multiple of 8, as masks are bits in whole bytes")
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.uint8(), length // 8))])
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.fs, self.inner, self.stream = _open(f"{path}.part", True)
        self.index_stream = _open(f"{path}.index.part", True)[2]
        self.writer, self.index = pa.ipc.new_file(self.stream, self.schema), pa.ipc.new_file(self.index_stream, self.index_schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = self.n_docs = 0
        self.bounds: list[tuple] = []

    def add(self, doc_ids: list[int | None], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Documents in their order: ids has all of theirs, one after the other."""
        starts = self.n_ids + np.cumsum(sizes) - sizes
        self.bounds += zip(doc_ids, starts.tolist(), sizes.tolist(), strict=True)
        self.held.append(ids.astype(self.dtype))
        self.n_held += len(ids)
        self.n_ids += len(ids)
        self.n_docs += len(doc_ids)
        if self.n_held >= BATCH * self.length:
            self._flush(False)
        if len(self.bounds) >= 4096:
            self._flush_index()

    def _flush(self, last: bool) -> None:
        """Write whole batches of what is held, and keep the rest; at the end, write that too. Thus only the last batch is short."""
        flat = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype)
        step = BATCH * self.length
        rest, n = np.zeros(0, self.dtype), len(flat)
        if last:
            flat = np.concatenate([flat, np.zeros(-n % self.length, self.dtype)])
        else:
            flat, rest = flat[: n // step * step], flat[n // step * step :]
        mask = np.packbits(np.arange(len(flat)) < n, bitorder="little")
        for a in range(0, len(flat), step):
            ids, on = pa.array(flat[a : a + step], self.kind), pa.array(mask[a // 8 : (a + step) // 8], pa.uint8())
            self.writer.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(x, k) for x, k in ((ids, self.length), (on, self.length // 8))], schema=self.schema))
        self.held, self.n_held = [rest], len(rest)

    def _flush_index(self) -> None:
        if self.bounds:
            self.index.write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in zip(*self.bounds, strict=True)], schema=self.index_schema))
            self.bounds = []

    def close(self) -> None:
        self._flush(True)
        self._flush_index()
        for x in (self.writer, self.index, self.stream, self.index_stream):
            x.close()
        # a name is there only when the file is whole; a second attempt writes the same bytes
        self.fs.move(f"{self.inner}", self.inner.removesuffix(".part"))
        self.fs.move(self.inner.removesuffix(".part") + ".index.part", self.inner.removesuffix(".part") + ".index")


def write_token_files(docs: DataFrame, folder: str, path: str, length: int = 2048, end_id: int = END_ID, n_shards: int | None = None) -> DataFrame:
    """Encode docs (doc_id, text) in ascending doc_id into files under folder; returns the manifest (shard, path, n_ids, n_docs).

    A shard holds a range of doc_ids as one stream of ids cut in sequences of `length`; only its last sequence is padded,
    where the bits of mask are 0. ids are 16-bit where the vocabulary allows. Null text is empty and leaves the end id alone; null
    doc_ids come first, repeated rows are written each, in any order of their own; an empty table writes no file. Extra columns, of
    whatever name, stay out. A very long text is encoded whole, in one task, and its ids go on over sequences and batches.
    """
    from tokenizers import Tokenizer

    width = pa.uint16() if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else pa.uint32()
    small_batches(docs.sparkSession)
    ordered = texts_of(docs).repartitionByRange(n_shards or partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, shard, number = None, None, TaskContext.get().partitionId()
        for batch in batches:
            if shard is None:
                vocabulary = Vocabulary.of(path)
                shard = _Shard(f"{folder}/shard-{number:06d}-{TaskContext.get().taskAttemptId()}.arrow", length, width)
            for a in range(0, len(batch), ENCODED):
                part = batch.slice(a, ENCODED)
                ids, sizes = vocabulary.encode(part["text"].to_pylist())
                shard.add(part["doc_id"].to_pylist(), np.insert(ids, np.cumsum(sizes), end_id), sizes + 1)
        if shard is not None:
            shard.close()
            yield pa.RecordBatch.from_pydict({"shard": [number], "path": [shard.path], "n_ids": [shard.n_ids], "n_docs": [shard.n_docs]}, schema=arrow_type(MANIFEST))

    spark, place = docs.sparkSession, f"{folder}/manifest"
    ordered.mapInArrow(write, MANIFEST).write.parquet(place)
    return spark.read.schema(MANIFEST).parquet(place)


def sequence(shard_path: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask) of the n-th sequence of a shard, which must have it: views of the mapped file, nothing is copied.

    The mask has a bit a token, the first in the lowest bit of the first byte; unpack_mask() makes booleans of it.
    """
    reader = pa.ipc.open_file(_open(shard_path, False)[2])
    batch = reader.get_batch(n // BATCH) if 0 <= n // BATCH < reader.num_record_batches else None
    row = n % BATCH
    if batch is None or row >= batch.num_rows:
        raise IndexError(f"{shard_path} has no sequence {n}")
    return batch["ids"].slice(row, 1).flatten().to_numpy(), batch["mask"].slice(row, 1).flatten().to_numpy()


def unpack_mask(mask: np.ndarray) -> np.ndarray:
    return np.unpackbits(mask, bitorder="little").view(bool)


def _stream(reader: pa.RecordBatchFileReader, column: str) -> Iterator[np.ndarray]:
    for i in range(reader.num_record_batches):
        yield reader.get_batch(i).column(column).flatten().to_numpy()


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files: one task per shard, a batch at a time."""
    # one row per shard: the ids before a shard are summed over the manifest, which does not grow with the documents
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.withColumn("before", before).select("shard", "path", "before")
    shards = shards.repartition(partitions(manifest.sparkSession), "shard")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                parts, held = _stream(pa.ipc.open_file(_open(row["path"], False)[2]), "ids"), np.zeros(0, np.uint16)
                index = pa.ipc.open_file(_open(row["path"] + ".index", False)[2])
                for i in range(index.num_record_batches):
                    bounds = index.get_batch(i)
                    sums = []
                    for n in bounds["n_tokens"].to_pylist():
                        crc = 0
                        while n:
                            if not len(held):
                                held = next(parts)
                            crc = zlib.crc32(held[:n].astype("<u4").tobytes(), crc)
                            n, held = n - min(n, len(held)), held[min(n, len(held)) :]
                        sums.append(crc)
                    start = np.asarray(bounds["start"]) + row["before"]
                    yield pa.RecordBatch.from_arrays([bounds["doc_id"], pa.array(start, pa.int64()), bounds["n_tokens"], pa.array(sums, pa.int64())], schema=arrow_type(schema))

    return shards.mapInArrow(read, schema)


def token_files(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write docs' files in the shared folder and read them back; nulls, repeated rows and extra columns as write_token_files() has them."""
    import public_tokenizers

    folder = f"{shared_dir(docs.sparkSession)}/skeinwork/tokens-{uuid.uuid4().hex}"
    return read_token_files(write_token_files(docs, folder, path or public_tokenizers.path(VOCABULARY)))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))
