"""Operator 13, periodic runs: every stretch of words that repeats with a period, by Lyndon arrays of two orders.

A run's root that is a Lyndon word, under an order of the words or its reverse, begins somewhere in the run, and the longest
Lyndon word there is that root. So both arrays name a candidate for every place, and how far the suffixes at its ends agree says
whether it is a run. Words are compared as ranks; no suffix structure and no hash of the text is built.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_SPLIT, small_batches, table, texts_of

#: Bytes of output that a task holds before it sends them on.
SEND_BYTES = 1 << 23


def lyndon_words(t: list[int]) -> tuple[list[int], list[int], int]:
    """(ends, shared, compared): where the longest Lyndon word at each place ends, how many symbols the suffixes at its ends share,
    and how often two symbols were compared.

    Places are taken from left to right, with those whose word is still open on a chain, each linked to the one before it. The
    suffix at a new place is compared with the chain's, the nearest first; it closes the word of each that is larger, and the
    first smaller one is its own link. Extensions that are known are used again:

    * along the chain: k was compared before, c is k's link. If the new suffix shares m symbols with k's, and k's shares u with
      c's, it shares min(m, u) with c's where m and u differ, and m at least where they are the same;
    * in what was matched already: of all comparisons so far, the one reaching farthest right, to `far`, found t[start:far] equal
      to what lies `back` before it. Two places in there stand as their images do; if those were compared and decided before
      the image of `far`, so are these. Otherwise these agree up to `far` at least.

    What is left to compare begins at `far`, and each success moves it on, so compared is at most 2 far + the comparisons that fail,
    one for each link made or word closed: linear. The end of the text counts as smaller than any symbol.
    """
    n = len(t)
    ends, shared, link, linked = [n] * n, [0] * n, [-1] * n, [0] * n
    far = start = compared = 0
    back = 1
    for j in range(1, n):
        c, k, m = j - 1, -1, 0
        while c >= 0:
            if k >= 0:
                u = linked[k]
                if m < u:  # decided against k where c is as k
                    ends[c], shared[c] = j, m
                    k, c = c, link[c]
                    continue
                if m > u:  # c differs from k first, and the new suffix does as k
                    link[j], linked[j] = c, u
                    break
            if j < far and c >= start:
                image, other = c - back, j - back
                if ends[image] == other and j + shared[image] < far:
                    m = shared[image]
                    ends[c], shared[c] = j, m
                    k, c = c, link[c]
                    continue
                if link[other] == image and j + linked[other] < far:
                    link[j], linked[j] = c, linked[other]
                    break
                m = max(m, far - j)
            a, b = c + m, j + m
            while b < n and t[a] == t[b]:
                a += 1
                b += 1
            compared += b - j - m + 1
            m = b - j
            if b >= far:
                far, start, back = b, j, j - c
            if b == n or t[b] < t[a]:
                ends[c], shared[c] = j, m
                k, c = c, link[c]
            else:
                link[j], linked[j] = c, m
                break
    return ends, shared, compared


def runs_of(ranks: list[int], times: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of `times` periods and `least` symbols at least, by start and period. times is 2 or more.

    A root whose left neighbour is the same root is passed over, so what is read to the left of one is less than its period, and
    less than what was matched to its right.
    """
    if times < 2:
        raise ValueError("times must be 2 or more")
    found = set()
    for t in (ranks, [-x for x in ranks]):
        ends, shared, _ = lyndon_words(t)
        for i, (j, r) in enumerate(zip(ends, shared)):
            p = j - i
            if r <= (times - 2) * p or (i >= p and ends[i - p] == i and shared[i - p] == r + p):
                continue
            a = i
            while a and t[a - 1] == t[a - 1 + p]:
                a -= 1
            if j + r - a >= max(least, times * p):
                found.add((a, j + r - a, p))
    return sorted(found, key=lambda x: (x[0], x[2]))


def periodic_runs(docs: DataFrame, times: int = 4, least: int = 6) -> DataFrame:
    """doc_id, n_words, runs (start, length and period, by start and period) and collapsed (the words that stay, joined by a space).

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text, numbered from 0, and equal as bytes. A word goes if a run holds it after the
    run's first period. Null and empty texts have no words: no runs, and an empty collapsed text. Repeated rows are searched each.
    An empty table gives no rows; extra columns, of whatever name, stay out. A text is searched in one piece, in time linear in
    its words and some 200 bytes a word; a row is worked on alone, so no key is hot and nothing is shuffled. Ties do not arise:
    no two runs of a text have start and period alike.
    """
    small_batches(docs.sparkSession, 100)
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, counts, texts, found, held = [], [], [], [], [], 0

        def sent() -> pa.RecordBatch:
            flat = np.array(found, np.int64).reshape(-1, 3)
            runs = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(run_type)))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), runs, pa.array(texts, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                words = text.as_py().split()
                runs = runs_of(pc.rank(pa.array(words, pa.binary()), tiebreaker="dense").to_pylist(), times, least)
                if runs:
                    change = np.zeros(len(words) + 1, np.int64)
                    for a, length, p in runs:
                        change[a + p] += 1
                        change[a + length] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
                    sizes.append(len(change) - 1)
                else:
                    sizes.append(len(words))
                ids.append(doc_id)
                counts.append(len(runs))
                found += runs
                texts.append(b" ".join(words))
                held += len(texts[-1]) + 24 * len(runs)
                if held >= SEND_BYTES:
                    yield sent()
                    ids, sizes, counts, texts, found, held = [], [], [], [], [], 0
        if ids:
            yield sent()

    texts = texts_of(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    made = texts.mapInArrow(search, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return made.withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, with every tenth document (crc32 of its decimal doc_id) repeating some of its words to its end.

    With h that checksum and g = h div 10, words from number a = g % n on become those from a on, repeated with period
    1 + (n - a) div (3 + g % 8). Texts without words, and rows without a doc_id, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = texts_of(docs).withColumn("g", F.when(h % 10 == 0, F.floor(h / 10)))
    rows = rows.withColumn("words", F.when(F.col("g").isNotNull(), F.filter(F.split("text", WORD_SPLIT), lambda w: w != "")))
    rows = rows.withColumn("a", F.expr("g % nullif(size(words), 0)")).withColumn("p", F.expr("1 + (size(words) - a) div (3 + g % 8)"))
    again = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select("doc_id", F.when(F.col("p").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs(planted(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), "best.length", (-F.col("best.period")).alias("period"), F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
