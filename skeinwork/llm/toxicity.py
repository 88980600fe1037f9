"""Operator 9, toxicity: many weak voters, a generative model of their accuracies and correlations, a linear classifier."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_type, mix, slices, small_batches, table, texts_of, word_hashes, word_spans
from .decontaminate import _LETTER

#: Bound of the rows that are fitted: labelled ones, and as many without a label. Every word and prefix of them may become a voter.
TRAIN_ROWS = 20_000
#: A word or prefix votes if it leans to label 1: with this log likelihood ratio over the label rate at least, and mostly. Among
#: some 10^5 words and prefixes chance alone gives a ratio of 8.5 to a handful; weaker ones make the model find the texts' length.
LEAST_GAIN, LEAST_SHARE = 8.5, 0.6
PREFIXES = (4, 5)
#: Pattern voters: shares of a text's characters, and the least share that votes toxic (fixed values).
PATTERNS = ((r"[^!]+", 0.01), (r"[^\p{Lu}]+", 0.3), (r"[^?]+", 0.02), (r"[^*#$%&@]+", 0.05))


def held_out(doc_id: Column) -> Column:
    """The fold whose labels are never read: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each feature, feature hash): the words of whole texts and their first 4 and 5 bytes."""
    for first, data, offsets in slices(texts):
        starts, ends, bounds = word_spans(data, offsets, _LETTER)
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        rows, hashes = [row], [word_hashes(data, starts, ends)]
        for n in PREFIXES:
            long = ends - starts > n
            rows.append(row[long])
            hashes.append(mix(word_hashes(data, starts[long], starts[long] + n) + np.uint64(n)))
        yield first, len(bounds) - 1, np.concatenate(rows), np.concatenate(hashes).view(np.int64)


def _training(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """doc_id, toxic (null if not labelled), pattern votes and distinct features: up to `rows` labelled documents of the training
    fold and as many without a label, each by smallest hash of doc_id. Held-out documents are in neither."""
    known = labels.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("chosen")).agg(F.max("toxic").cast("int").alias("toxic"))
    free = docs.select(F.col("doc_id").cast("long").alias("chosen")).filter(F.col("chosen").isNotNull() & ~held_out(F.col("chosen"))).distinct().join(known.filter("toxic is not null"), "chosen", "left_anti")
    some = [x.orderBy(F.xxhash64("chosen"), "chosen").limit(rows) for x in (known.filter("toxic is not null"), free.withColumn("toxic", F.lit(None).cast("int")))]
    votes = F.array(*[(F.length(F.regexp_replace("text", p, "")) > least * F.length("text")).cast("int") for p, least in PATTERNS])
    texts = texts_of(docs).join(F.broadcast(some[0].union(some[1])), F.col("doc_id") == F.col("chosen")).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    texts = texts.select("doc_id", "toxic", votes.alias("votes"), F.lower("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, row, h in _features(batch["text"]):
                part = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["toxic"], part["votes"], pa.array(_by_row(row, h, n), pa.list_(pa.int64()))], ["doc_id", "toxic", "votes", "f"])

    return texts.mapInArrow(run, "doc_id long, toxic int, votes array<int>, f array<long>")


def _by_row(row: np.ndarray, h: np.ndarray, n: int) -> list[list[int]]:
    order = np.argsort(row, kind="stable")
    edges = np.searchsorted(row[order], np.arange(n + 1))
    return [np.unique(h[order[a:b]]).tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)]


def label_model(row: np.ndarray, voter: np.ndarray, n: int, sens: np.ndarray, fals: np.ndarray, prior: float, core: int, rounds: int = 25) -> np.ndarray:
    """Posteriors of label 1 of n rows from hits (row, voter), by EM over each voter's hit rates in either class.

    A voter that does not hit abstains; one whose rate is higher in class 0 votes for that. Voters that still agree when the
    label is given repeat one another: those whose residual correlation exceeds 0.5 form a cluster (linked ones join), and each
    one's evidence is divided by the cluster's size. sens and fals are where EM starts, prior is the share of label 1, which the
    posteriors keep; no row's label is given. Correlations are looked for among the first `core` voters, in the rows where one
    of them hits, some thousand rows at a time.
    """
    j = len(sens)
    weight = np.ones(j)
    some = np.flatnonzero(voter < core)
    some = some[np.argsort(row[some], kind="stable")]
    core_row, core_voter = row[some], voter[some]
    hit = np.unique(core_row)
    times = np.bincount(voter, minlength=j)
    for step in range(rounds):
        s, f = np.clip(sens, 1e-4, 0.99), np.clip(fals, 1e-4, 0.99)
        z = np.bincount(row, (np.log(s / f) * weight)[voter], n)
        low, high = -60.0, 60.0
        for _ in range(40):  # the shift at which the posteriors' mean is the prior
            middle = (low + high) / 2
            post = 1 / (1 + np.exp(-np.clip(z + middle, -50, 50)))
            low, high = (middle, high) if post.mean() < prior else (low, middle)
        a = post.sum()
        toxic = np.bincount(voter, post[row], j)
        # a hit in neither class is as likely as the voter is frequent, so that few hits say little
        rate = (times + 0.5) / (n + 1)
        sens, fals = (toxic + 2 * rate) / (a + 2), (times - toxic + 2 * rate) / (n - a + 2)
        if step in (0, 5, 10):
            together = np.zeros((core, core), np.float32)
            for at in range(0, len(hit), 2000):
                ids = hit[at : at + 2000]
                here = slice(np.searchsorted(core_row, ids[0]), np.searchsorted(core_row, ids[-1], "right"))
                x = -(post[ids, None] * sens[:core] + (1 - post[ids, None]) * fals[:core]).astype(np.float32)
                x[np.searchsorted(ids, core_row[here]), core_voter[here]] += 1
                together += x.T @ x
            spread = np.sqrt(np.diag(together)) + 1e-9
            linked = together / spread[:, None] / spread[None, :] > 0.5
            np.fill_diagonal(linked, True)
            cluster = np.arange(core)
            for _ in range(core):
                new = np.where(linked, cluster[None, :], core).min(1)
                if (new == cluster).all():
                    break
                cluster = new
            weight[:core] = 1 / np.bincount(cluster, minlength=core)[cluster]
    return post


def _lexicon(rows: DataFrame, belief: DataFrame, rate: float) -> dict[int, tuple[float, float]]:
    """hash: (weight in class 1, in class 0) of the words and prefixes that lean to label 1, by beliefs (doc_id, p) in the rows' labels."""
    counts = rows.join(F.broadcast(belief), "doc_id").select("p", F.explode("f").alias("h")).groupBy("h").agg(F.sum("p").alias("pos"), F.sum(1 - F.col("p")).alias("neg"))
    df = F.col("pos") + F.col("neg")
    gain = F.col("pos") * F.log(F.col("pos") / (df * rate)) + F.when(F.col("neg") > 1e-9, F.col("neg") * F.log(F.col("neg") / (df * (1 - rate)))).otherwise(0.0)
    leans = counts.filter(F.col("pos") > LEAST_SHARE * df).withColumn("gain", F.round(gain, 6)).filter(F.col("gain") >= LEAST_GAIN)
    return {r.h: (r.pos, r.neg) for r in leans.orderBy(F.desc("gain"), "h").collect()}


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature hashes sorted, their weights, bias) of the linear classifier, learned from the training fold alone.

    Labels say which words and prefixes may vote and how much at first, and at the end scale the score (two numbers). What
    each voter is worth is the label model's estimate over labelled and unlabelled rows alike; with its posteriors the lexicon
    is looked for once more, now in all rows, and the model fitted again. The classifier learns its posteriors, not the labels.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    rows = scratch.write(_training(docs, labels, train_rows), "rows")
    data = rows.select("doc_id", "toxic", "votes").orderBy("doc_id").toPandas()
    ids, gold, n = data["doc_id"].to_numpy(), data["toxic"].to_numpy(float), len(data)
    known = ~np.isnan(gold)
    positive = float(gold[known].sum())
    if not positive or positive == known.sum():
        scratch.drop()
        return np.zeros(0, np.int64), np.zeros(0), float(np.log((positive + 0.5) / (known.sum() - positive + 0.5)))
    prior = positive / known.sum()
    patterns = np.array([[v or 0 for v in x] for x in data["votes"]], bool)
    belief, weight = np.where(known, gold, 0.0), known.astype(float)
    for _ in range(3):
        some = weight > 0
        words = _lexicon(rows, spark.createDataFrame(pd.DataFrame({"doc_id": ids[some], "p": belief[some]})), float(belief[some].mean()))
        hits = rows.select("doc_id", F.array_intersect("f", F.array(*[F.lit(h) for h in words]) if words else F.array().cast("array<long>")).alias("f")).filter(F.size("f") > 0).toPandas()
        place = {h: i for i, h in enumerate(words)}
        row = np.repeat(np.searchsorted(ids, hits["doc_id"].to_numpy()), hits["f"].map(len).to_numpy(int))
        col = np.array([place[h] for f in hits["f"] for h in f], np.int64)
        none = np.flatnonzero(np.bincount(row, minlength=n) == 0)
        at, which = np.nonzero(patterns)
        # besides the words: the patterns, and a voter that hits where no word does
        votes_row, voter = np.concatenate([row, at, none]), np.concatenate([col, len(words) + which, np.full(len(none), len(words) + patterns.shape[1])])
        sure = (belief * weight)[votes_row], ((1 - belief) * weight)[votes_row]
        a, b = (belief * weight).sum(), ((1 - belief) * weight).sum()
        sens, fals = ((np.bincount(voter, x, len(words) + patterns.shape[1] + 1) + 0.5) / (k + 1) for x, k in zip(sure, (a, b), strict=True))
        belief, weight = label_model(votes_row, voter, n, sens, fals, prior, len(words)), np.ones(n)
    scratch.drop()
    w, b, vw, vb = np.zeros(len(words)), 0.0, np.zeros(len(words)), 0.0
    for _ in range(600):
        z = b + np.bincount(row, w[col], n)
        g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - belief) / n
        vw, vb = 0.9 * vw - 4.0 * (np.bincount(col, g[row], len(w)) + 1e-5 * w), 0.9 * vb - 4.0 * g.sum()
        w, b = w + vw, b + vb
    # the labels' last word: one scale and one shift of the score, by Newton's steps on their log loss with a little smoothing
    z, y = (b + np.bincount(row, w[col], n))[known], np.clip(gold[known], 0.02, 0.98)
    ab, x = np.array([1.0, 0.0]), np.stack([z, np.ones(len(z))], axis=1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        ab = ab - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - y) + 1e-3 * (ab - [1.0, 0.0]))
    hashes = np.array(list(words), np.int64)
    order = np.argsort(hashes)
    return hashes[order], ab[0] * w[order], float(ab[0] * b + ab[1])


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text.

    score is the classifier's probability over the text's distinct features; null or empty text scores the bias alone, a
    null doc_id is not held out and never trains, repeated rows are scored each and train once. Without labels of both kinds
    every score is the label rate; an empty table gives no rows; extra columns are ignored.
    """
    small_batches(docs.sparkSession)
    hashes, weights, bias = fit(docs, labels)
    sieve = np.zeros(1 << 16, bool)
    sieve[hashes & 0xFFFF] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, row, h in _features(batch["text"]):
                z = np.full(n, bias)
                maybe = np.flatnonzero(sieve[h & 0xFFFF])
                if len(maybe):
                    at = np.minimum(np.searchsorted(hashes, h[maybe]), len(hashes) - 1)
                    real = hashes[at] == h[maybe]
                    pairs = np.unique(row[maybe[real]].astype(np.int64) * len(hashes) + at[real])
                    z += np.bincount(pairs // len(hashes), weights[pairs % len(hashes)], n)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(first, n), pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))], schema=arrow_type("doc_id long,score double"))

    scored = texts_of(docs).withColumn("text", F.lower("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
