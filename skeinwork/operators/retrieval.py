"""Lexical ranking and brute-force vector search as joins and aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Scratch
from .paths import sensitive


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75, most: int = 20) -> DataFrame:
    """(query_id, doc_id, score): each query's `most` best documents by score, the smallest doc_id first of equals.

    docs: doc_id, text; queries: query_id, term, a short list. Terms are lower-case runs of letters and digits. A term that
    half of the documents have, or more, weighs 1e-6. A document is counted in its row: of its words only the queries' terms
    leave it, with their times.
    """
    terms = queries.agg(F.collect_set("term").alias("t")).scalar()
    words = docs.select("doc_id", F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+"), lambda w: w != "").alias("w")).withColumn("terms", terms)
    rows = words.select("doc_id", F.size("w").alias("size"), F.filter("w", lambda w: F.array_contains("terms", w)).alias("hits"))
    sizes = rows.agg(F.count("*").alias("n"), F.avg("size").alias("avg_size"))
    tf = rows.select("doc_id", "size", "hits", F.explode(F.array_distinct("hits")).alias("term"))
    tf = tf.select("doc_id", "size", "term", F.size(F.filter("hits", lambda h: h == F.col("term"))).alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    scored = tf.join(df, "term").withColumn("n", sizes.select("n").scalar()).withColumn("avg_size", sizes.select("avg_size").scalar())
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.when(idf > 0, idf).otherwise(1e-6) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("avg_size")))
    total = scored.withColumn("part", part).join(queries, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return total.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= most).drop("k")


def top_vectors(vectors: DataFrame, queries: DataFrame, block: int = 4096) -> DataFrame:
    """(query_id, vec_id, dot): each query's vector of the largest dot product, the smallest vec_id of equals; null vectors are left out.

    Queries are stored in blocks of `block`, and every partition of vectors is multiplied with each block as matrices: one block
    is sent to the tasks at a time, whose size is bounded whatever the number of queries, and a task gives one row a query. The
    query set is a stated one; a block of it is one pass over the vectors. Products are of doubles.
    """
    spark = vectors.sparkSession
    placed = Scratch(spark, "queries").write(queries.filter("q is not null").select(F.col("query_id").cast("long"), F.col("q").cast("array<double>").alias("q")), "queries")
    n = placed.count()
    numbered = placed.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n // block)))))
    rows = vectors.filter("embedding is not null").select(F.col("vec_id").cast("long"), "embedding")
    out = spark.createDataFrame([], "query_id long, vec_id long, dot double")
    for part in range(max(1, -(-n // block))):
        held = numbered.filter(F.col("part") == part).select("query_id", "q").toArrow()
        ids = np.asarray(held["query_id"])
        if not len(ids):
            continue
        matrix = np.array(held["q"].to_pylist(), np.float64).reshape(len(ids), -1)
        out = out.unionByName(rows.mapInArrow(_best_of(ids, matrix), "query_id long, vec_id long, dot double"))
    return out.groupBy("query_id").agg(F.max(F.struct("dot", (-F.col("vec_id")).alias("v"))).alias("m")).select("query_id", (-F.col("m.v")).alias("vec_id"), "m.dot")


def _best_of(ids: np.ndarray, matrix: np.ndarray):
    """The function of a task that gives, for each query, its best vector of the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, at = np.full(len(ids), -np.inf), np.zeros(len(ids), np.int64)
        for batch in batches:
            vec = batch["vec_id"].to_numpy(zero_copy_only=False)
            if not len(vec):
                continue
            data = batch["embedding"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vec), -1)
            for a in range(0, len(ids), 512):  # so products of one batch stay small
                dots = matrix[a : a + 512] @ data.T
                most = dots.max(axis=1)
                least = np.where(dots == most[:, None], vec[None, :], np.iinfo(np.int64).max).min(axis=1)
                old, was = top[a : a + 512], at[a : a + 512]
                new = (most > old) | ((most == old) & (least < was))
                top[a : a + 512], at[a : a + 512] = np.where(new, most, old), np.where(new, least, was)
        found = top > -np.inf
        yield pa.RecordBatch.from_arrays([pa.array(ids[found]), pa.array(at[found]), pa.array(top[found])], ["query_id", "vec_id", "dot"])

    return run


def expanded_terms(text: Column, most: int = 12) -> Column:
    """The first `most` search terms: words of three characters or more, then for each two neighbours camelCase, snake_case and PascalCase.

    Words are runs of A-Z, a-z, 0-9 and _; neighbours of under two characters give none. Terms differ by case; repeats are left out.
    """
    words = F.filter(F.split(text, "[^A-Za-z0-9_]+"), lambda w: w != "")
    low = F.transform(words, lambda w: F.lower(w))
    head = lambda w: F.concat(F.upper(F.substring(w, F.lit(1), F.lit(1))), F.substring(w, F.lit(2), F.length(w)))
    rest = F.greatest(F.size(low) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(low, F.lit(1), rest), F.slice(low, F.lit(2), rest), lambda a, b: F.when(
        (F.length(a) > 1) & (F.length(b) > 1), F.array(F.concat(a, head(b)), F.concat(a, F.lit("_"), b), F.concat(head(a), head(b)))).otherwise(F.array().cast("array<string>")))
    terms = F.array_distinct(F.filter(F.concat(words, F.flatten(pairs)), lambda t: F.length(t) >= 3))
    return F.slice(terms, 1, most)


def word_hits(files: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, doc_id, line, term): lines that have a term as a whole word. files: doc_id, text; terms: query_id, term.

    A line's words that are terms are kept before anything is exploded to rows of their own key: terms meet lines by equality.
    """
    lines = files.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("i", "body"))
    words = lines.select("doc_id", (F.col("i") + 1).alias("line"), F.explode(F.array_distinct(F.split("body", "[^A-Za-z0-9_]+"))).alias("term"))
    return words.join(terms.distinct(), "term").select("query_id", "doc_id", "line", "term")


def lexical_files(hits: DataFrame, most: int = 20) -> DataFrame:
    """(query_id, doc_id, n, truncated): the files with most hits of each query, a line counted once a term; truncated where others follow."""
    counts = hits.groupBy("query_id", "doc_id").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "doc_id")))
    seen = ranked.filter(F.col("k") <= most + 1).withColumn("truncated", F.max("k").over(Window.partitionBy("query_id")) > most)
    return seen.filter(F.col("k") <= most).select("query_id", "doc_id", "n", "truncated")


def snippets(docs: DataFrame, hits: DataFrame, terms: DataFrame, width: int = 24) -> DataFrame:
    """(query_id, doc_id, first, body): of each hit document the window of `width` tokens with the most of the query's terms.

    docs: doc_id, text; hits: query_id, doc_id, a few documents a query, which are sent to the texts; terms: query_id, term in lower case. Tokens are what lies between spaces; one counts
    where a run of letters and digits in it is a term. A window begins with such a token, unless it ends with the text or begins with
    it; of those with equally many the first is taken. first is its place from 0, body has a mark where the text goes on.
    """
    asked = terms.groupBy("query_id").agg(F.collect_set("term").alias("terms"))
    tokens = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    rows = docs.join(F.broadcast(hits.select("query_id", "doc_id").join(asked, "query_id")), "doc_id").select("query_id", "doc_id", "terms", tokens.alias("tokens"))
    found = F.transform("tokens", lambda w: F.arrays_overlap(F.split(F.lower(w), "[^a-z0-9]+"), "terms").cast("int"))
    places = rows.select("query_id", "doc_id", "tokens", F.filter(F.transform(found, lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull()).alias("at"))
    last = F.greatest(F.size("tokens") - width, F.lit(0))
    starts = F.array_distinct(F.concat(F.array(F.lit(0)), F.transform("at", lambda i: F.least(i, last))))
    tried = places.select("query_id", "doc_id", "tokens", "at", F.explode(starts).alias("first"))
    n = F.size(F.filter("at", lambda i: (i >= F.col("first")) & (i < F.col("first") + width)))
    best = tried.withColumn("n", n).groupBy("query_id", "doc_id").agg(F.max_by(F.struct("first", "tokens"), F.struct("n", -F.col("first"))).alias("b"))
    cut = F.array_join(F.slice("b.tokens", F.col("b.first") + 1, F.lit(width)), " ")
    body = F.concat(F.when(F.col("b.first") > 0, "… ").otherwise(""), cut, F.when(F.col("b.first") + width < F.size("b.tokens"), " …").otherwise(""))
    return best.select("query_id", "doc_id", F.col("b.first").alias("first"), body.alias("body"))


#: Files and matches of a literal search, and signs of a line that are shown (fixed values).
GREP_FILES, GREP_MATCHES, GREP_WIDTH = 40, 200, 300


def grep(files: DataFrame, patterns: DataFrame, most_files: int = GREP_FILES, most: int = GREP_MATCHES, width: int = GREP_WIDTH) -> DataFrame:
    """(query_id, path, line, text, truncated, reason): lines that hold a pattern as it is, in order of path and line, up to the caps.

    files: path, text; patterns: query_id, pattern, word (whether it must not be part of a longer word), a short list; blank ones
    find nothing. Sensitive paths are left out. A query shows its first `most_files` files and of those the first `most` lines;
    truncated where there are more, with the reason, files first. text is cut after `width` signs and marked.

    A file is read twice: first each counts its lines by query, and only those numbers leave it; then the files that are shown,
    `most_files` a query, give their lines. So no text is shuffled but what may be shown.
    """
    asked = patterns.filter(F.trim(F.coalesce("pattern", F.lit(""))) != "").select("query_id", "pattern", F.coalesce("word", F.lit(False)).alias("word"))
    quoted = F.regexp_replace("pattern", r"([^A-Za-z0-9\s])", r"\\$1")
    whole = F.when(F.col("word"), F.concat(F.lit("(?<![A-Za-z0-9_])"), quoted, F.lit("(?![A-Za-z0-9_])")))
    # a line counts once a query, whichever of its patterns it holds
    queries = asked.groupBy("query_id").agg(F.collect_set(F.struct("pattern", "word", whole.alias("whole"))).alias("any"))
    holds = lambda line, query: F.exists(query["any"], lambda p: F.contains(line, p["pattern"]) & (~p["word"] | F.rlike(line, p["whole"])))
    rows = files.filter(~sensitive(F.col("path"))).select("path", F.coalesce("text", F.lit("")).alias("text"))
    # the array of one binds the lines, so that a text is split once and not for every query
    counts = F.element_at(F.transform(F.array(F.split("text", "\n", -1)), lambda lines: F.transform(
        "queries", lambda q: F.struct(q["query_id"].alias("query_id"), F.size(F.filter(lines, lambda x: holds(x, q))).cast("long").alias("n")))), 1)
    counted = rows.withColumn("queries", queries.agg(F.collect_list(F.struct("query_id", "any"))).scalar()).select("path", F.inline(F.filter(counts, lambda c: c["n"] > 0)))
    order = Window.partitionBy("query_id").orderBy("path")
    # the planner keeps a query's first files before it shuffles them, so one with many is not gathered
    first = counted.withColumn("k", F.dense_rank().over(order)).filter(F.col("k") <= most_files + 1).groupBy("query_id", "path", "k").agg(F.sum("n").alias("n"))
    numbered = Scratch(files.sparkSession, "grep").write(first.withColumn("before", F.sum("n").over(order) - F.col("n")), "files")
    totals = numbered.groupBy("query_id").agg((F.max("k") > most_files).alias("over"), F.sum(F.when(F.col("k") <= most_files, F.col("n"))).alias("shown"))
    kept = numbered.filter((F.col("k") <= most_files) & (F.col("before") < most)).select("query_id", "path", "before").join(queries, "query_id")
    lines = rows.join(F.broadcast(kept), "path").select("query_id", "path", "before", "any", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    hits = lines.filter(holds(F.col("text"), {"any": F.col("any")})).withColumn("line", F.col("line") + 1)
    place = F.col("before") + F.row_number().over(Window.partitionBy("query_id", "path").orderBy("line"))
    out = hits.withColumn("place", place).filter(F.col("place") <= most).join(totals, "query_id")
    reason = F.when(F.col("over"), f"more than {most_files} files").when(F.col("shown") > most, f"more than {most} matches")
    cut = F.when(F.length("text") > width, F.concat(F.substring("text", 1, width), F.lit("…"))).otherwise(F.col("text"))
    return out.select("query_id", "path", "line", cut.alias("text"), reason.isNotNull().alias("truncated"), reason.alias("reason"))
