"""Operator 8, quality rules: counting rules and a hashed n-gram likelihood ratio, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_SPLIT, Scratch, durable, table

SYMBOLS = "#*$%&|<>"
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Steps of a score in which the labelled rows are counted for the threshold.
SCORE_STEPS = 10_000
#: Labelled documents that are sent to every task (some 300 MB there).
BROADCAST_IDS = 10_000_000


def _words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_SPLIT), lambda w: w != "")


def _once(value: Column, use) -> Column:
    """use(value) with value computed once: a transform over a one-element array binds it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeated(hashes: Column) -> Column:
    """Words under a 3-word window that the text holds twice or more, from the words' hashes.

    34 hash bits and the 30-bit place of each window share one long, so one primitive sort brings equal windows together
    (a text of 2^31 bytes has no more places). Of those, the whole hashes decide. The places found, in order, each cover
    three words less what the next one covers too.
    """
    place = (1 << 30) - 1
    windows = F.transform(
        F.sequence(F.lit(1), F.size(hashes) - 2),
        lambda i: F.xxhash64(F.element_at(hashes, i), F.element_at(hashes, i + 1), F.element_at(hashes, i + 2)),
    )

    def same_neighbour(s: Column, key) -> Column:
        return F.filter(
            s,
            lambda x, j: F.when(j > 0, key(F.element_at(s, F.greatest(j, F.lit(1)))) == key(x)).otherwise(False)
            | F.when(j + 1 < F.size(s), key(F.element_at(s, F.least(j + 2, F.size(s)))) == key(x)).otherwise(False),
        )

    def count(w: Column) -> Column:
        keys = F.sort_array(F.transform(w, lambda h, j: h.bitwiseAND(F.lit(~place)).bitwiseOR(j.cast("long"))))
        maybe = _once(keys, lambda s: same_neighbour(s, lambda x: F.shiftright(x, 30)))
        exact = F.transform(maybe, lambda x: _once(x.bitwiseAND(F.lit(place)).cast("int"), lambda j: F.struct(F.element_at(w, j + 1).alias("h"), j.alias("j"))))
        twice = _once(F.sort_array(exact), lambda s: same_neighbour(s, lambda x: x["h"]))
        places = F.sort_array(F.transform(twice, lambda x: x["j"]))
        covered = _once(
            places,
            lambda p: F.aggregate(
                F.transform(p, lambda x, j: F.when(j + 1 < F.size(p), F.least(F.lit(3), F.element_at(p, F.least(j + 2, F.size(p))) - x)).otherwise(3)), F.lit(0), lambda a, x: a + x
            ),
        )
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered)

    return F.when(F.size(hashes) < 4, F.lit(0)).otherwise(_once(windows, count)).cast("long")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def base_rules(docs: DataFrame) -> DataFrame:
    """row (docs' columns as a struct, so that no name clashes), the counts of the base rules, base_failed, and the words' hashes h."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(F.col("t"), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.select(F.struct(*docs.columns).alias("row"), text.alias("t")).withColumn("w", _words(F.col("t"))).withColumn("h", _hashes(F.col("w")))
    return out.select(
        "row",
        "h",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.when(F.instr("t", "\n") == 0, F.lit(0)).otherwise(_once(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("h")).alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _features(h: Column, buckets: int) -> Column:
    """Bucket numbers of the words and of the word pairs, from the words' hashes. A bit mask cannot be null, as a remainder could:
    arrays that hold no null are sorted as plain numbers."""
    if buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")
    one = F.transform(h, lambda x: x.bitwiseAND(F.lit(buckets - 1)).cast("int"))
    pairs = F.transform(F.sequence(F.lit(1), F.size(h) - 1), lambda i: F.xxhash64(F.element_at(h, i), F.element_at(h, i + 1)).bitwiseAND(F.lit(buckets - 1)).cast("int"))
    return F.when(F.size(h) > 1, F.concat(one, pairs)).otherwise(one)


def _known(labels: DataFrame) -> DataFrame:
    """labelled_id, quality of every labelled document, once each: 1 where any of its labels says so."""
    rows = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    return rows.groupBy(F.col("doc_id").alias("labelled_id")).agg(F.max("quality").cast("int").alias("quality"))


def _small(ids: DataFrame) -> DataFrame:
    """ids to be sent to every task while they are few enough for that; more are met by a shuffle, which takes the texts along."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def bucket_counts(docs: DataFrame, trusted: DataFrame, buckets: int) -> DataFrame:
    """bucket, raw (its count over every document) and good (its count over the trusted ones), a row for each of the buckets."""
    rows = docs.select("doc_id", _hashes(_words(F.coalesce(F.col("text"), F.lit("")))).alias("h")).join(trusted, F.col("doc_id") == F.col("labelled_id"), "left")
    counts = (
        rows.select(F.col("labelled_id").isNotNull().cast("long").alias("is_trusted"), F.explode(_features(F.col("h"), buckets)).alias("bucket"))
        .groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("is_trusted").alias("good"))
    )
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("raw", "good")])


def _model(counts: DataFrame) -> Column:
    """One row: the counts as arrays by bucket, and their totals."""
    got = F.sort_array(F.collect_list(F.struct("bucket", F.col("raw").cast("double").alias("raw"), F.col("good").cast("double").alias("good"))))
    arrays = F.transform(got, lambda x: x["raw"]).alias("raw"), F.transform(got, lambda x: x["good"]).alias("good")
    return counts.agg(F.struct(*arrays, F.sum("raw").cast("double").alias("raw_all"), F.sum("good").cast("double").alias("good_all")).alias("m")).scalar()


def with_score(judged: DataFrame, known: DataFrame, counts: DataFrame, buckets: int, smoothing: float) -> DataFrame:
    """judged (row, h and more) with quality, its label or null, and score: the mean of ln(p_trusted / p_raw) over the features, all counts without the document's own.

    p_trusted backs off to p_raw: (good + prior p_raw) / (good_all + prior), prior = smoothing * buckets. A bucket that the
    trusted documents say nothing of thus counts little, and none at all counts 0 where no trusted document is left.
    """
    prior = smoothing * buckets
    rows = judged.join(known, F.col("row.doc_id") == F.col("labelled_id"), "left").withColumn("own", F.coalesce("quality", F.lit(0)).cast("double")).drop("labelled_id")
    rows = rows.withColumn("f", F.sort_array(_features(F.col("h"), buckets))).withColumn("m", _model(counts))
    rows = rows.select("*", *[F.col("m")[c].alias(f"m_{c}") for c in ("raw", "good", "raw_all", "good_all")]).drop("m")
    n = F.size("f").cast("double")

    def gain(bucket: Column, times: Column) -> Column:
        p_raw = (F.get(F.col("m_raw"), bucket) - times + 1.0) / (F.col("m_raw_all") - n + float(buckets))
        return times * F.log((F.get(F.col("m_good"), bucket) - F.col("own") * times) / p_raw + prior)

    # where runs of equal buckets end, counted from 1, and how long each is
    rows = rows.withColumn("ends", F.when(n > 0, F.filter(F.sequence(F.lit(1), F.size("f")), lambda j: ~F.get("f", j).eqNullSafe(F.get("f", j - 1)))))
    rows = rows.withColumn("times", F.transform("ends", lambda j, i: (j - F.coalesce(F.get("ends", i - 1), F.lit(0))).cast("double")))
    total = F.aggregate(F.zip_with("ends", "times", lambda j, t: gain(F.get("f", j - 1), t)), F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn("score", F.when(n > 0, total / n - F.log(F.col("m_good_all") - F.col("own") * n + prior)).otherwise(0.0))
    return rows.drop("own", "f", "ends", "times", "m_raw", "m_good", "m_raw_all", "m_good_all")


def held_out_threshold(scored: DataFrame) -> float:
    """The score that parts the held-out scores of labelled rows (quality, base_failed, score) past the base rules best: the most of good ones at or over it plus bad ones under it.

    Of equally good values, the middle of the lowest run. Where a class has no row there is nothing to part: no document is
    dropped by its score. Scores are counted in steps of 1 / SCORE_STEPS, so what comes to the driver is bounded.
    """
    counted = scored.filter("quality is not null").groupBy("base_failed", "quality", F.floor(F.col("score") * SCORE_STEPS).cast("long").alias("step")).count().collect()
    by = [{r["step"]: r["count"] for r in counted if r["quality"] == q and not r["base_failed"]} for q in (0, 1)]
    if not by[0] or not by[1]:
        return float("-inf")
    bad, good = (sum(x.values()) for x in by)
    places = sorted({*by[0], *by[1]})
    # dropping the steps up to a place: bad ones won less good ones lost, as shares of their classes (times bad * good)
    value, best, low, high = 0, 0, places[0] - 1, places[0]
    for i, p in enumerate(places):
        value += by[0].get(p, 0) * good - by[1].get(p, 0) * bad
        if value > best:
            best, low, high = value, p, places[i + 1] if i + 1 < len(places) else p + 1
    return (low + 1 + high) / 2 / SCORE_STEPS


def quality_rules(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 14, smoothing: float = 1.0, threshold: float | None = None) -> DataFrame:
    """row (docs' columns as a struct) with the base counts, base_failed, score and kept.

    score is the mean of ln(p_trusted / p_raw) over a document's hashed words and word pairs, with counts that leave the
    document out; kept needs score >= threshold and no base rule failed, the same for every document. The threshold, where
    none is given, comes from the labelled rows past the base rules, whose scores are held out likewise: it fits the table
    and its labels. The trusted multinomial and the threshold take every labelled document.
    The model is two arrays of `buckets` numbers, whatever the corpus has. Null or empty text has no words, scores 0 and
    fails the base rule. Repeated rows are counted and judged each.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    known = _small(scratch.write(_known(labels), "known"))
    counts = scratch.write(bucket_counts(docs, known.filter("quality = 1"), buckets), "counts")
    # every document is judged once, and written: a filter on a verdict reads it, and does not work the rules out anew
    judged = durable(with_score(base_rules(docs), known, counts, buckets, smoothing).drop("h"), "quality-judged")
    if threshold is None:
        threshold = held_out_threshold(judged)
    scratch.drop()
    judged = judged.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    return judged.select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, table(spark, sf_dir, "labels")).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
