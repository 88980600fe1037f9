"""Operator 4, benchmark decontamination: spaced-seed hashes find hits, ungapped alignments around them decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_type, combine, durable, slices, small_batches, table, text_key, texts_of, word_hashes, word_spans

#: Seeds over consecutive words: a word under 0 may differ (fixed values). Any two differing words in a span of 12 or more leave
#: a match under one of them. An item shorter than a seed is one seed of all its words.
MASKS = ("11101101", "11011011", "10110111", "11111000", "00011111")
#: Bits of the sieve that all tasks carry; its size is fixed whatever the benchmark holds.
SIEVE_BITS = 22
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _seeds(words: np.ndarray, bounds: np.ndarray, short: tuple[int, ...] = ()) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, hashes) of every seed that lies within one row, and of every run of so many words as `short` names."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for m, mask in enumerate((*MASKS, *("1" * k for k in short))):
        n = len(words) - len(mask) + 1
        if n > 0:
            at = np.flatnonzero(row[:n] == row[len(mask) - 1 :])
            kind = m if m < len(MASKS) else 100 + len(mask)
            yield at, combine([np.full(len(at), kind, np.uint64)] + [words[at + i] for i, c in enumerate(mask) if c == "1"])


def _words_of(texts: pa.Array):
    """Per slice of rows: (first row, word hashes, word bounds of the rows, byte starts and ends). Punctuation is no word."""
    for first, data, offsets in slices(texts):
        starts, ends, bounds = word_spans(data, offsets, _LETTER)
        yield first, word_hashes(data, starts, ends), bounds


def _sequences(frame: DataFrame, key: str) -> DataFrame:
    """(key, words): the word hashes of each text (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, words, bounds in _words_of(batch["text"]):
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(words.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch[key].slice(first, len(bounds) - 1), lists], [key, "words"])

    kind = "binary" if frame.schema[key].dataType.typeName() == "binary" else "long"
    return frame.select(F.col(key).cast(kind).alias(key), F.lower(F.coalesce("text", F.lit(""))).alias("text")).mapInArrow(run, f"{key} {kind}, words array<long>")


def _seed_table(items: DataFrame) -> DataFrame:
    """(seed, item_id, item_key, place) of every seed of every item; an item shorter than a seed is one seed of all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item_id, key, item in zip(batch["item_id"].to_pylist(), batch["item_key"].to_pylist(), batch["item"].to_pylist(), strict=True):
                words = np.array(item, np.int64).view(np.uint64)
                found = list(_seeds(words, np.array([0, len(words)]), (len(words),) if len(words) < len(MASKS[0]) else ()))
                at, h = np.concatenate([a for a, _ in found]), np.concatenate([h for _, h in found])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), item_id)), pa.array(np.full(len(h), key)), pa.array(at.astype(np.int64))], ["seed", "item_id", "item_key", "place"])

    return items.mapInArrow(run, "seed long, item_id long, item_key long, place long")


def _verdict(same: np.ndarray, need: int, min_match: float) -> tuple[int, int, int] | None:
    """(words, equal words, begin) of the best run of a diagonal, where it is long and equal enough; same has no gap."""
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
    least = np.minimum.accumulate(total)
    end = int(np.argmax(total - least))
    begin = int(np.argmax(total[: end + 1] == least[end]))
    n, equal = end - begin, int(same[begin:end].sum())
    if (n < need or equal < min_match * n) and len(same) >= need:
        # a poorer stretch beside a good one: of the runs of as many words as needed, the first of the most equal ones decides
        sums = np.concatenate([[0], np.cumsum(same)])
        begin = int(np.argmax(sums[need:] - sums[:-need]))
        n, equal = need, int(sums[begin + need] - sums[begin])
    return (n, equal, begin) if n >= need and equal >= min_match * n else None


def passages(docs: DataFrame, benchmark: DataFrame, min_words: int = 12, min_match: float = 0.8) -> DataFrame:
    """(tkey, item_id, n_words, n_match, first_word): the texts, by their text_key(), that repeat a benchmark item.

    Words are runs of letters and digits, without case. Every seed of every text is held against the seeds of the
    benchmark. Where one hits, all of the item is aligned with the text's words on the hit's diagonal, and the best run (a
    match counts 1, a differing word -2) decides: it must have min_words words, or be the whole of a shorter item, and
    min_match of them equal; where the best run falls short, any min_words consecutive words with min_match equal do. Words may
    be substituted, not inserted; an inserted word starts another diagonal, of which each is judged. An item of fewer words
    than a seed matches word for word. One row per text and item, the one of the most equal words.

    Equal texts are one; null and empty texts and items, and items with a null item_id, never match; of items with one item_id
    each different text counts; extra columns are ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "passages")
    items = _sequences(benchmark.filter(F.col("item_id").isNotNull()), "item_id").select("item_id", F.xxhash64("words").alias("item_key"), F.col("words").alias("item"))
    items = scratch.write(items.filter(F.size("item") > 0).dropDuplicates(["item_id", "item_key"]), "items")
    seeds = scratch.write(_seed_table(items), "seeds")
    short = tuple(r.n for r in items.select(F.size("item").alias("n")).filter(F.col("n") < len(MASKS[0])).distinct().collect())  # at most 7 lengths
    # The sieve is a bit array of fixed size; what passes it is joined exactly, so a crowded sieve costs time alone.
    words64 = (1 << SIEVE_BITS) // 64
    bits = seeds.select((F.shiftrightunsigned("seed", 6).bitwiseAND(F.lit(words64 - 1))).cast("int").alias("cell"), F.col("seed").bitwiseAND(F.lit(63)).alias("bit")).distinct()
    cells = np.zeros(words64, np.uint64)
    for cell, value in bits.groupBy("cell").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("value")).collect():
        cells[cell] = np.int64(value).view(np.uint64)
    sieve = spark.sparkContext.broadcast(cells)
    hit_schema = "tkey binary, seed long, at long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = sieve.value
        for batch in batches:
            for first, words, bounds in _words_of(batch["text"]):
                for at, h in _seeds(words, bounds, short):
                    cell = (h >> np.uint64(6)) & np.uint64(words64 - 1)
                    keep = np.flatnonzero((on[cell] >> (h & np.uint64(63))) & np.uint64(1))
                    if len(keep):
                        at, h = at[keep], h[keep]
                        row = np.searchsorted(bounds, at, "right") - 1
                        yield pa.RecordBatch.from_arrays([batch["tkey"].take(pa.array(first + row)), pa.array(h.view(np.int64)), pa.array((at - bounds[row]).astype(np.int64))], schema=arrow_type(hit_schema))

    texts = texts_of(docs).select(text_key("text").alias("tkey"), "text")
    hits = texts.withColumn("text", F.lower("text")).mapInArrow(scan, hit_schema).join(seeds, "seed")
    # hits of one diagonal say the same
    lanes = scratch.write(hits.select("tkey", "item_id", "item_key", (F.col("at") - F.col("place")).alias("shift")).distinct(), "lanes")
    found = _sequences(texts.join(lanes.select("tkey").distinct(), "tkey", "left_semi"), "tkey").dropDuplicates(["tkey"])
    both = found.join(lanes, "tkey").join(items, ["item_id", "item_key"])
    low, high = F.greatest(F.lit(0), -F.col("shift")), F.least(F.size("item"), F.size("words") - F.col("shift"))
    part = both.select("tkey", "item_id", F.size("item").alias("size"), (low + F.col("shift")).alias("first"), F.slice("words", (low + F.col("shift") + 1).cast("int"), (high - low).cast("int")).alias("a"), F.slice("item", (low + 1).cast("int"), (high - low).cast("int")).alias("b"))
    schema = "tkey binary, item_id long, n_words long, n_match long, first_word long"

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            a, b = ((c.flatten().to_numpy(), np.cumsum([0, *np.diff(np.asarray(c.offsets))])) for c in (batch["a"], batch["b"]))
            columns = (batch[c].to_pylist() for c in ("tkey", "item_id", "size", "first"))
            for i, (tkey, item_id, size, first) in enumerate(zip(*columns, strict=True)):
                same = a[0][a[1][i] : a[1][i + 1]] == b[0][b[1][i] : b[1][i + 1]]
                if (got := _verdict(same, min(min_words, size), min_match)) is not None:
                    rows.append((tkey, item_id, got[0], got[1], first + got[2]))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64() if i else pa.binary()) for i in range(5)], schema=arrow_type(schema))

    best = F.max(F.struct("n_match", "n_words", (-F.col("first_word")).alias("f"))).alias("b")
    out = part.mapInArrow(verify, schema).groupBy("tkey", "item_id").agg(best).select("tkey", "item_id", F.col("b.n_words").alias("n_words"), F.col("b.n_match").alias("n_match"), (-F.col("b.f")).alias("first_word"))
    out = durable(out, "passages-found")
    scratch.drop()
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = 12, min_match: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_words, n_match, first_word): the documents of passages(), a row per document and item.

    Repeated rows give equal rows once; rows without a doc_id are found like others, with a null one.
    """
    found = passages(docs, benchmark, min_words, min_match)
    return texts_of(docs).select("doc_id", text_key("text").alias("tkey")).distinct().join(found, "tkey").drop("tkey")


def without_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text repeats a benchmark item; all columns stay as they are."""
    bad = passages(docs, benchmark).select("tkey").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    return rows.join(bad, text_key("row.text") == F.col("tkey"), "left_anti").select("row.*")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
