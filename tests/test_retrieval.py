"""Postings over generations, literal search with its caps, and snippets."""

import random
import re

import pytest
from pyspark.sql import functions as F

from skeinwork.operators import postings, retrieval


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["the"] * 20
    return [(i, None if i % 41 == 7 else " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60)))) for i in range(n)]


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "w3"), (1, "w9"), (2, "the"), (2, "w1"), (3, "nowhere")], "query_id int, term string")


def ranked(df):
    return sorted((r.query_id, r.doc_id, r.score) for r in df.collect())


def test_index_ranks_as_the_texts_do(spark, queries, tmp_path):
    rows = texts(1, 200)
    index = postings.Index(spark, f"file://{tmp_path}/i", 8).build(docs(spark, rows).repartition(5))
    assert ranked(index.bm25(queries)) == ranked(retrieval.bm25(docs(spark, rows), queries))
    changed, gone = [(i, f"w3 w3 new{i} the") for i in range(0, 200, 7)] + [(500, "w9 w9"), (501, None)], [3, 7, 10, 999]
    index.refresh(docs(spark, changed), spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    now = dict(rows) | dict(changed)
    now = [(i, t) for i, t in now.items() if i not in gone or i in dict(changed)]
    assert ranked(index.bm25(queries)) == ranked(retrieval.bm25(docs(spark, now), queries))
    index.refresh(docs(spark, [(3, "w9 back again"), (0, "")]))
    now = list((dict(now) | {3: "w9 back again", 0: ""}).items())
    assert ranked(index.bm25(queries)) == ranked(retrieval.bm25(docs(spark, now), queries))
    last = index.generations()[-1]
    assert (last["n"], last["words"]) == (len(now), sum(len((t or "").split()) for _, t in now))


def test_repeated_and_half_written_generations(spark, queries, tmp_path):
    index = postings.Index(spark, f"file://{tmp_path}/i", 4).build(docs(spark, texts(2, 60)))
    before = ranked(index.bm25(queries))
    index.build(docs(spark, [(1, "w3")]))  # there is one
    assert ranked(index.bm25(queries)) == before
    # a generation that was lost before its last file was written is not there, and is replaced when it comes again
    docs(spark, [(1, "w3 w3 w3")]).select(F.lit("w3").alias("term"), "doc_id", F.lit(3).alias("tf"), F.lit(3).alias("size"), F.lit(0).alias("bucket")).write.partitionBy("bucket").parquet(f"{tmp_path}/i/postings/generation=2")
    assert ranked(index.bm25(queries)) == before
    index.refresh(docs(spark, [(2, "w9")]), generation=2)
    once = ranked(index.bm25(queries))
    assert ranked(index.refresh(docs(spark, [(5, "w9")]), generation=2).bm25(queries)) == once != before
    with pytest.raises(ValueError):
        index.refresh(docs(spark, []), generation=9)


def test_a_query_reads_its_terms_buckets_alone(spark, tmp_path):
    index = postings.Index(spark, f"file://{tmp_path}/i", 16).build(docs(spark, texts(3, 100)))
    plan = index.postings(["w3"])._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0] and "In(term" in plan or "EqualTo(term,w3)" in plan
    empty = postings.Index(spark, f"file://{tmp_path}/e", 4).build(docs(spark, []))
    assert empty.bm25(spark.createDataFrame([(1, "w3")], "query_id int, term string")).count() == 0


def brute(files, patterns, most_files, most, width=300):
    out = []
    for q, pattern, word in patterns:
        hits = []
        for path, text in sorted(files):
            if pattern.strip() and not path.endswith(".pem"):
                for i, line in enumerate((text or "").split("\n"), 1):
                    if re.search(rf"(?<!\w){re.escape(pattern)}(?!\w)" if word else re.escape(pattern), line, re.A):
                        hits.append((path, i, line if len(line) <= width else line[:width] + "…"))
        names = sorted({h[0] for h in hits})
        shown = [h for h in hits if h[0] in names[:most_files]]
        reason = f"more than {most_files} files" if len(names) > most_files else f"more than {most} matches" if len(shown) > most else None
        out += [(q, *h, reason is not None, reason) for h in shown[:most]]
    return sorted(out)


def test_grep(spark):
    rng = random.Random(5)
    signs = ["a", "b", "a.*b", "ab", "(x", "Check", "Checkpoint", "$1\\", "é日", " ", "\n", "_a", "the the"]
    files = [(f"f{i:02}{'.pem' if i % 9 == 4 else ''}", None if i == 3 else "".join(rng.choice(signs) for _ in range(rng.randrange(60)))) for i in range(60)] + [("long", "y" * 400 + "Check")]
    patterns = [(1, "a.*b", False), (2, "Check", True), (3, "Check", False), (4, "", False), (5, "  ", False), (6, "a", True), (7, "$1\\", False), (8, "é日", False), (9, "(x", True), (10, "nothing", False), (11, "ab", False), (12, "a", False)]
    f, p = spark.createDataFrame(files, "path string, text string").repartition(3), spark.createDataFrame(patterns, "query_id int, pattern string, word boolean")
    for most_files, most in ((40, 200), (5, 200), (40, 7), (1, 1)):
        assert sorted(tuple(r) for r in retrieval.grep(f, p, most_files, most).collect()) == brute(files, patterns, most_files, most), (most_files, most)


def test_grep_counts_files_where_they_lie(spark):
    """No line is dealt by its text, and a query of two patterns counts a line that has both once."""
    files = [(f"f{i:02}", "both ab cd\nab\nnone\n" * 3) for i in range(5)]
    patterns = [(1, "ab", False), (1, "cd", True), (2, "cd", True)]
    found = retrieval.grep(spark.createDataFrame(files, "path string, text string"), spark.createDataFrame(patterns, "query_id int, pattern string, word boolean"), 2, 7)
    assert not re.search(r"hashpartitioning\([^)]*text#", found._jdf.queryExecution().executedPlan().toString())
    got = sorted((r.query_id, r.path, r.line, r.reason) for r in found.collect())
    assert got == [(1, "f00", i, "more than 2 files") for i in (1, 2, 4, 5, 7, 8)] + [(1, "f01", 1, "more than 2 files")] + [(2, f, i, "more than 2 files") for f in ("f00", "f01") for i in (1, 4, 7)]


def test_terms_are_counted_where_they_lie(spark, tmp_path):
    rows = docs(spark, [(1, "b a b, B c"), (2, None), (3, "... !"), (4, "a"), (5, "a a")])
    found = postings.counted(postings.sorted_words(rows))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == [(1, 5, "a", 1), (1, 5, "b", 3), (1, 5, "c", 1), (4, 1, "a", 1), (5, 2, "a", 2)]
    # rows of one document and size are one posting, as they were
    index = postings.Index(spark, f"file://{tmp_path}/i", 4).build(docs(spark, [(1, "a b"), (1, "a c"), (2, "b")]))
    assert sorted(tuple(r) for r in index.postings(["a", "b"]).collect()) == [("a", 1, 2, 2), ("b", 1, 1, 2), ("b", 2, 1, 1)]


def test_snippets_do_not_deal_texts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = retrieval.snippets(docs(spark, [(1, "a license")]), spark.createDataFrame([(1, 1)], "query_id int, doc_id long"), spark.createDataFrame([(1, "license")], "query_id int, term string"), 5)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin [doc_id" in plan and "hashpartitioning(doc_id" not in plan


def test_snippets(spark):
    rows = docs(spark, [(1, "a b c License, d e f license g"), (2, "x license"), (3, " ".join(["n"] * 30 + ["license", "license"])), (4, None)])
    hits = spark.createDataFrame([(1, i) for i in (1, 2, 3)], "query_id int, doc_id long")
    got = {r.doc_id: (r["first"], r.body) for r in retrieval.snippets(rows, hits, spark.createDataFrame([(1, "license")], "query_id int, term string"), 5).collect()}
    assert got == {1: (3, "… License, d e f license …"), 2: (0, "x license"), 3: (27, "… n n n license license")}
