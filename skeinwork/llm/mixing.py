"""Operator 6, mixing to target weights: soft domain membership, and document rates by projected gradient least squares."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices, small_batches, table, word_spans

DIMS = 1024
#: Room above the least total of a mixture that may shrink no document.
SLACK = 1.02
_GAP = np.uint32(0x9E3779B1)


def _trigrams(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, unit-length hashed byte trigram counts, words) of whole texts, by slices."""
    for first, data, offsets in slices(texts, 1 << 19):
        n = len(offsets) - 1
        row = np.repeat(np.arange(n), np.diff(offsets))
        d = data.astype(np.uint32)
        x = np.zeros((n, DIMS))
        if len(d) > 2:
            key = ((d[:-2] << np.uint32(16)) | (d[1:-1] << np.uint32(8)) | d[2:]) * _GAP >> np.uint32(22)
            inside = row[:-2] == row[2:]
            x = np.bincount(row[:-2][inside] * DIMS + key[inside].astype(np.int64), minlength=n * DIMS).reshape(n, DIMS).astype(float)
        x = np.sqrt(x)
        _, _, bounds = word_spans(data, offsets)
        yield first, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9), np.diff(bounds)


def fit_domains(docs: DataFrame, labels: DataFrame, domain: str, sample: int, steps: int = 300) -> tuple[list[str], np.ndarray]:
    """Domain names and softmax weights, fitted on the `sample` labelled documents with the smallest hash: a bounded sample."""
    known = labels.select(F.col("doc_id").alias("labelled")).filter("labelled is not null").distinct().orderBy(F.xxhash64("labelled"), "labelled").limit(sample)
    rows = docs.filter(F.col(domain).isNotNull()).select("doc_id", F.col(domain).cast("string").alias("domain"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(known), F.col("doc_id") == F.col("labelled")).groupBy("doc_id").agg(F.min(F.struct("domain", "text")).alias("r")).select("r.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, x, _ in _trigrams(batch["text"]):
                yield pa.RecordBatch.from_arrays([batch["domain"].slice(first, len(x)), pa.array([r.astype(np.float32).tobytes() for r in x], pa.binary())], ["domain", "x"])

    got = sorted((r.domain, bytes(r.x)) for r in rows.mapInArrow(run, "domain string, x binary").collect())
    names = sorted({d for d, _ in got})
    if not names:
        return [], np.zeros((DIMS + 1, 0))
    x = np.array([np.frombuffer(b, np.float32) for _, b in got]).astype(np.float64)
    x = np.hstack([x, np.ones((len(x), 1))])
    y = np.eye(len(names))[[names.index(d) for d, _ in got]]
    w, v = np.zeros((DIMS + 1, len(names))), np.zeros((DIMS + 1, len(names)))
    for _ in range(steps):  # gradient descent with momentum on the regularised softmax loss
        v = 0.9 * v - 1.0 * (x.T @ (_softmax(x @ w) - y) / len(x) + 1e-5 * w)
        w = w + v
    return names, w


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def posteriors(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """row (docs' columns as a struct), n_tokens (words) and p (array of domain posteriors) of every document."""
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # the names of docs cannot clash with the new ones
    text, names = f"c{docs.columns.index('text')}", named.columns
    fields = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in named.schema] + ["n_tokens long", "p array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, x, words in _trigrams(batch[text]):
                p = _softmax(np.hstack([x, np.ones((len(x), 1))]) @ weights)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
                part = batch.slice(first, len(x))
                yield pa.RecordBatch.from_arrays([*[part[c] for c in names], pa.array(words.astype(np.int64)), lists], [*names, "n_tokens", "p"])

    row = F.struct(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
    return named.mapInArrow(run, fields).select(row.alias("row"), "n_tokens", "p")


def fit_step(soft: DataFrame, k: int, target: np.ndarray, least: float = 0.0, total: float | None = None, tolerance: float = 1e-5, most: int = 60) -> list[float]:
    """The summed step of the rates (see rate()) with which the sums of rate * n_tokens * p come to total * target, over soft (n_tokens, p).

    Projected gradient: every round sums the domains' totals over all documents at the projected rates, and the k x k moment
    matrix of the documents that are not held at the bound; the gradient, scaled by that matrix, is added to the step, half of
    it where all would bring the totals no nearer. total defaults to the least at which no domain must shrink, times SLACK where
    rates have a bound above 0: raising one domain's documents raises what they hold of others a little. Where `most` rounds don't reach the targets, as none can if the posteriors say nothing, a warning gives what is off.
    """
    tokens = F.col("n_tokens")

    def sums(step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        free = F.when(_moved(list(step)) >= least, tokens).otherwise(0)
        found = [F.sum(tokens * rate(list(step), least) * F.col("p")[i]) for i in range(k)] + [F.sum(free * F.col("p")[i] * F.col("p")[j]) for i in range(k) for j in range(k)]
        row = np.array([float(x or 0) for x in soft.agg(*found).first()])
        return row[:k], row[k:].reshape(k, k)

    step, size = np.zeros(k), 1.0
    have, moment = sums(step)
    if total is None:
        total = (SLACK if least > 0 else 1.0) * max((have[i] / target[i] for i in range(k) if target[i] > 0), default=0.0)
    want = total * target
    move = np.linalg.pinv(moment, rcond=1e-9) @ (want - have)
    for _ in range(most):
        if np.abs(have - want).max(initial=0) <= tolerance * max(total, 1.0):
            break
        now, then = sums(step + size * move)
        if np.linalg.norm(now - want) < np.linalg.norm(have - want):
            step, have, size = step + size * move, now, 1.0
            move = np.linalg.pinv(then, rcond=1e-9) @ (want - have)
        elif size > 1e-3:
            size /= 2
        else:
            break
    off = np.abs(have - want).max(initial=0) / max(total, 1.0)
    if off > tolerance:
        warnings.warn(f"the mixture's largest domain error is {off:.2g} of all tokens", stacklevel=2)
    return [float(x) for x in step]


def _moved(step: list[float]) -> Column:
    return sum((F.lit(float(x)) * F.col("p")[i] for i, x in enumerate(step)), F.lit(1.0))


def rate(step: list[float], least: float = 0.0) -> Column:
    """A document's rate: 1 and the step along its posteriors p, projected to `least` and above. So no round keeps a table."""
    return F.greatest(F.lit(float(least)), _moved(step))


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, domain: str = "lang", sample: int = 2000, temper: float = 0.7, total: float | None = None, least: float = 0.0) -> DataFrame:
    """row (docs' columns as a struct), n_tokens, p, rate and copies: how often each document belongs in the mixture.

    A softmax classifier fitted on a bounded sample of the labelled rows predicts each document's domain posteriors; no
    document's own domain column is used beyond that sample. weights (normalised) default to the corpus shares to the power
    `temper`. Rates are `least` at least: with 1 every document stays, and the targets are met by what is repeated.
    copies = floor(rate + u) with u a hash of doc_id, so its mean is the rate. Null text is empty and counts no tokens; a null
    domain trains nothing; without any labelled row there is one domain of all; repeated rows are rated each, and copied alike;
    of rows with one doc_id, one trains; an empty table gives no rows. Extra columns travel in row, so no name can clash; very long
    texts are read in slices.
    """
    spark = docs.sparkSession
    small_batches(spark)
    names, w = fit_domains(docs, labels, domain, sample)
    if not names:
        names, w = ["all"], np.zeros((DIMS + 1, 1))
    scratch = Scratch(spark, "mix")
    soft = scratch.write(posteriors(docs, w).select("n_tokens", "p"), "posteriors")
    if weights is None:
        row = soft.agg(*[F.sum(F.col("n_tokens") * F.col("p")[i]) for i in range(len(names))]).first()
        share = np.array([float(x or 0) for x in row]) ** temper
    else:
        share = np.array([float(weights.get(n, 0.0)) for n in names])
    target = share / share.sum() if share.sum() > 0 else np.full(len(names), 1 / len(names))
    step = fit_step(soft, len(names), target, least, total)
    scratch.drop()
    u = F.pmod(F.xxhash64("row.doc_id", F.lit("mix")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    # the posteriors are worked out again beside the texts, which are not written for it
    return posteriors(docs, w).withColumn("rate", rate(step, least)).withColumn("copies", F.floor(F.col("rate") + u).cast("int"))


def mixture(mixed: DataFrame) -> DataFrame:
    """The documents of a mixture (from mix()), each `copies` times; those of 0 copies are left out.

    All columns of the documents come back as they were, whatever their names and nulls; repeated rows are copied each; an empty
    mixture gives no rows. A document is copied in its row, so long texts are held once at a time.
    """
    return mixed.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return mix(docs, table(spark, sf_dir, "labels")).select("row.doc_id", "n_tokens", "p", F.round("rate", 6).alias("rate"), "copies")
