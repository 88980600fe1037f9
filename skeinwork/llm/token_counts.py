"""Operator 7, token counts: pieces once per distinct pre-token, joined to each document's pre-token frequencies."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_type, durable, pack, partitions, small_batches, table, texts_of, unpack
from .vocab import Vocabulary

#: Characters of text that one block of documents holds; a block's distinct pre-tokens travel once.
BLOCK_CHARS = 4_000_000


def _spread(words: list[str], buckets: int) -> np.ndarray:
    return (pd.util.hash_array(np.array(words, dtype=object), categorize=False) % np.uint64(buckets)).astype(np.int64)


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text.

    A block of documents is stored with its distinct pre-tokens, by hash buckets, and who has them how often. The pre-tokens alone go
    to the buckets, where the tokenizer counts the pieces of each distinct one once; a number for each goes back to its block,
    which multiplies and sums beside its documents. A frequent pre-token is one entry a block, whoever has it, so no bucket
    grows with a word's documents. Texts that cannot be cut safely outside the library (special strings, rare scripts) are
    counted whole where they are read, and so is every text of a vocabulary other than word_bpe_49k.json.

    Null or empty text has 0 tokens; a null doc_id stays null; repeated rows are counted each; an empty table gives no rows; extra
    columns, of whatever name, stay out. A very long text ends its block.
    """
    spark = docs.sparkSession
    buckets = 4 * partitions(spark)
    small_batches(spark)
    scratch = Scratch(spark, "counts")
    dealt = "bucket int, block long, n_docs int, docs binary, words binary, pairs binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.of(path)
        number = TaskContext.get().partitionId() * 0x10001  # 65,536 blocks a task at most, dealt to all buckets

        def block(rows: list[tuple], number: int) -> pa.RecordBatch:
            where: dict[str, list[int]] = defaultdict(list)
            sizes, whole = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            for d, (_, text) in enumerate(rows):
                sizes[d] = len(text.encode("utf-8", "surrogatepass"))
                found = vocabulary.frequencies(text)
                if found is None:
                    whole[d] = len(vocabulary.whole(text))
                    continue
                for w, n in found.items():
                    where[w] += (d, n)
            words = list(where)
            bucket = _spread(words, buckets) if words else np.zeros(0, np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out = {c: [] for c in arrow_type(dealt).names}
            home = number % buckets
            for b in range(buckets):
                mine = [words[i] for i in order[edges[b] : edges[b + 1]]]
                if not mine and b != home:
                    continue
                lists = [where[w] for w in mine]
                flat = np.fromiter((x for one in lists for x in one), np.int32)
                counts = np.fromiter((len(one) // 2 for one in lists), np.int32)
                # the documents themselves go with one bucket, another one for each block
                known = pack(np.array([i or 0 for i, _ in rows], np.int64), np.array([i is None for i, _ in rows]), sizes, whole) if b == home else None
                for c, x in zip(out, (b, number, len(rows), known, pack(np.frombuffer("\n".join(mine).encode(), np.uint8)), pack(flat[::2], flat[1::2], counts)), strict=True):
                    out[c].append(x)
            return pa.RecordBatch.from_pydict(out, schema=arrow_type(dealt))

        held, n = [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                text = text.as_py()
                held.append((doc_id, text))
                n += len(text)
                if n >= BLOCK_CHARS:
                    yield block(held, number)
                    held, n, number = [], 0, number + 1
        if held:
            yield block(held, number)

    back = "block long, bucket int, pieces binary"

    def count(group: pd.DataFrame) -> pd.DataFrame:
        vocabulary = Vocabulary.of(path)
        lists = [x.decode().split("\n") if (x := unpack(w, np.uint8)[0].tobytes()) else [] for w in group["words"]]
        distinct = sorted(set().union(*lists))
        pieces: dict[str, int] = {}
        for a in range(0, len(distinct), 10_000):
            part = distinct[a : a + 10_000]
            pieces.update(zip(part, map(len, vocabulary.ids_of(part)), strict=True))
        packed = [pack(np.fromiter((pieces[w] for w in words), np.int32, len(words))) for words in lists]
        return pd.DataFrame({"block": group["block"], "bucket": group["bucket"], "pieces": packed})

    done = "doc_id long, n_bytes long, n_tokens long"

    def gather(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids, null, sizes, total = (x.copy() for x in unpack(left["docs"].dropna().iloc[0], np.int64, bool, np.int64, np.int64))
        pieces = dict(zip(right["bucket"], right["pieces"], strict=True))
        for bucket, pairs in zip(left["bucket"], left["pairs"], strict=True):
            doc, times, counts = unpack(pairs, np.int32, np.int32, np.int32)
            each = np.repeat(unpack(pieces[bucket], np.int32)[0].astype(np.int64), counts)
            total += np.bincount(doc, each * times, len(ids)).astype(np.int64)
        return pd.DataFrame({"doc_id": pd.Series(ids, dtype="Int64").mask(null), "n_bytes": sizes, "n_tokens": total})

    # stored in buckets of the block, so what is known of a block is brought to it and it stays where it is
    blocks = scratch.write_bucketed(texts_of(docs).mapInArrow(send, dealt), "blocks", "block", 2 * partitions(spark))
    counted = blocks.select("bucket", "block", "words").groupBy("bucket").applyInPandas(count, back)
    out = durable(blocks.groupBy("block").cogroup(counted.groupBy("block")).applyInPandas(gather, done), "token-counts")
    scratch.drop()
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
