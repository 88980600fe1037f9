"""Helpers that the corpus operators share: tables, the shared folder, and vectorised word hashing inside tasks."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these characters (fixed values of the contract).
SPACES = b" \t\n\x0b\x0c\r"
WORD_SPLIT = r"[\x20\x09-\x0D]+"
#: Text bytes that a task turns into arrays at once; bounds a task's memory whatever a batch holds.
SLICE_BYTES = 1 << 18
#: Stands for a null doc_id: before all others.
NULL_ID = np.iinfo(np.int64).min


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """The cluster's shuffle width; bucket counts follow it, so a bucket stays bounded as the input and the width grow."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='skeinwork-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Where durable() notes what it writes, while keeping() holds.
_KEPT: ContextVar[list[str] | None] = ContextVar("kept", default=None)


@contextlib.contextmanager
def keeping(paths: list[str]) -> Iterator[None]:
    """Note in paths every table that durable() writes meanwhile, for free()."""
    token = _KEPT.set(paths)
    try:
        yield
    finally:
        _KEPT.reset(token)


def free(spark: SparkSession, paths: list[str]) -> None:
    """Delete the tables; what reads them must have been written before. paths is empty afterwards."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    paths.clear()


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df in the shared folder and read it back: lineage ends there, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skeinwork/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if (kept := _KEPT.get()) is not None:
        kept.append(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """A folder in the shared one for the tables that one run of an operator writes and reads; drop() frees them all."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/skeinwork/{name}-{uuid.uuid4().hex}"
        self.tables: dict[str, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """df written under name and read back: lineage ends there, and a lost executor loses nothing of it."""
        path = f"{self.path}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """As write(), in buckets of the key's hash: grouping by the key reads a bucket a task, and shuffles nothing of df."""
        self.tables[name] = f"skeinwork_{uuid.uuid4().hex}"
        df.write.bucketBy(buckets, key).format("parquet").option("path", f"{self.path}/{name}").option("compression", "zstd").saveAsTable(self.tables[name])
        return self.spark.read.table(self.tables[name])

    def drop(self, name: str = "") -> None:
        """Delete the table of that name, or all; what reads them must have been written before."""
        for t in [name] if name else list(self.tables):
            if t in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(t)}")
        free(self.spark, [f"{self.path}/{name}" if name else self.path])


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most this many rows between the JVM and Python, so long texts do not fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of successive runs of rows with about limit bytes, at least one row each. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    yield from cut(np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8), offsets, limit)


def cut(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """slices() of rows that are bytes and offsets already."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


_WORD = np.ones(256, bool)
_WORD[list(SPACES)] = False
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_LOWER += 1
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * SLICE_BYTES, _BASE)]))
_INVERSES = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * SLICE_BYTES, np.uint64(pow(int(_BASE), -1, 1 << 64)))]))


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each row and in all): words do not cross rows."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, with A-Z as a-z: a polynomial of the bytes, from running sums where the slice fits the table of powers."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    if len(data) < len(_POWERS):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LOWER[data] * _POWERS[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * _INVERSES[starts] + mix(lengths.astype(np.uint64)))
    first = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(int(lengths.max()), _BASE)]))
    values = _LOWER[data[within + np.repeat(starts, lengths)]] * powers[within]
    return mix(np.add.reduceat(values, first) + mix(lengths.astype(np.uint64)))


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of a sequence of equally long hash arrays; the order matters."""
    h = np.full(len(parts[0]), 0x51_7C_C1_B7_27_22_0A_95, np.uint64)
    for p in parts:
        h = mix(h * _BASE + p)
    return h


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays to one compressed value; unpack() takes their types in the same order."""
    head = np.array([len(a) for a in arrays], np.int64).tobytes()
    body = head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True)


def unpack(blob: bytes, *types: object) -> list[np.ndarray]:
    body = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    counts = np.frombuffer(body, np.int64, len(types))
    out, at = [], 8 * len(types)
    for n, kind in zip(counts, types, strict=True):
        kind = np.dtype(kind)
        out.append(np.frombuffer(body, kind, int(n), at))
        at += int(n) * kind.itemsize
    return out


def text_blocks(docs: DataFrame, limit: int) -> DataFrame:
    """(block, ids, body): whole documents in blocks of about limit bytes, compressed. read_block() gives their arrays."""
    schema = "block long, ids binary, body binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, n = TaskContext.get().partitionId() << 32, [], [], 0

        def done() -> pa.RecordBatch:
            offsets = np.cumsum([0, *map(len, texts)])
            keys = np.array([NULL_ID if i is None else i for i in ids], np.int64)
            return pa.RecordBatch.from_pydict({"block": [number], "ids": [pack(keys, offsets)], "body": [pack(np.frombuffer(b"".join(texts), np.uint8))]}, schema=arrow_type(schema))

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.large_binary()), strict=True):
                text = text.as_py()
                if texts and n + len(text) > limit:
                    yield done()
                    number, ids, texts, n = number + 1, [], [], 0
                ids.append(doc_id)
                texts.append(text)
                n += len(text)
        if texts:
            yield done()

    return texts_of(docs).mapInArrow(run, schema)


def read_block(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, with NULL_ID for null; byte offsets; bytes) of a block's documents."""
    ids, offsets = unpack(row["ids"], np.int64, np.int64)
    return ids, offsets, unpack(row["body"], np.uint8)[0]


def arrow_type(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(",")])


def text_key(text: str | Column) -> Column:
    """What names a whole text, null as empty: 128 bits, so of 10^10 texts no two are expected to share one."""
    return F.unhex(F.md5(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")))


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text alone, null text as empty: nothing else of a wide or clashing table travels."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)
