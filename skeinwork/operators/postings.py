"""A stored index of terms: where each occurs and how often, so a query reads its terms' parts alone."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import Files

POSTINGS = "term string, doc_id long, tf int, size int, generation int, bucket int"
DOCS = "doc_id long, size int, generation int"
#: Shares of documents that a bucket's postings are dealt to (fixed value).
SHARES = 16


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def sorted_words(docs: DataFrame) -> DataFrame:
    """doc_id, w (the words of the text in order, repeats with them), size."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sort_array(words(F.col("text"))).alias("w")).withColumn("size", F.size("w"))


def counted(rows: DataFrame) -> DataFrame:
    """(doc_id, size, term, tf) of sorted words: a document counts its terms where it lies, as runs of equal words, by where they end."""
    ends = F.filter(F.sequence(F.lit(1), F.size("w")), lambda j: ~F.get("w", j).eqNullSafe(F.get("w", j - 1)))
    runs = F.transform("ends", lambda j, i: F.struct(F.get("w", j - 1).alias("term"), (j - F.coalesce(F.get("ends", i - 1), F.lit(0))).alias("tf")))
    return rows.filter("size > 0").withColumn("ends", ends).select("doc_id", "size", F.inline(runs))


@dataclass(frozen=True)
class Index:
    """Postings in generations: the first of all documents, each later one of those that changed.

    A generation is a folder of postings by bucket of the term, in order of term, and one of its documents. Its last file says
    how many documents live, and how many words they have, after it; without that file a generation is not there, and writing
    it again replaces what it left. A posting counts where no later generation has its document.
    """

    spark: SparkSession
    folder: str
    buckets: int = 64

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def generations(self) -> list[dict]:
        log = Files(self.spark, f"{self.folder}/log")
        return [json.loads(log.read(n)) for n in log.names() if n.endswith(".json")]

    def _read(self, kind: str, schema: str, generations: list[dict]) -> DataFrame:
        """Generations are folders, so the reader leaves out those that are not wanted."""
        names = [f"{self.folder}/{kind}/generation={g['generation']}" for g in generations if Files(self.spark, f"{self.folder}/{kind}/generation={g['generation']}").names()]
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{kind}").parquet(*names) if names else self.spark.createDataFrame([], schema)

    def _write(self, docs: DataFrame, gone: DataFrame | None, totals: dict) -> Index:
        number = totals["generation"]
        rows = sorted_words(docs)
        counts = counted(rows)
        # dealt once, by bucket and share of the documents, so a term that all documents have is written by several tasks
        dealt = counts.withColumn("bucket", self._bucket(F.col("term"))).repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(SHARES))).sortWithinPartitions("bucket", "term", "doc_id")
        dealt.write.partitionBy("bucket").mode("overwrite").parquet(f"{self.folder}/postings/generation={number}")
        sizes = rows.select("doc_id", "size")
        if gone is not None:
            sizes = sizes.unionByName(gone.withColumn("size", F.lit(None).cast("int")))
        sizes.write.mode("overwrite").parquet(f"{self.folder}/docs/generation={number}")
        n = self._read("docs", DOCS, [totals]).agg(F.count("size").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
        Files(self.spark, f"{self.folder}/log").create(f"{number:06d}.json", json.dumps(totals | {"n": totals["n"] + n.n, "words": totals["words"] + n.words}))
        return self

    def build(self, docs: DataFrame) -> Index:
        """The first generation, of all documents (doc_id, text; one row each); nothing if there is one."""
        return self if self.generations() else self._write(docs, None, {"generation": 1, "n": 0, "words": 0})

    def refresh(self, changed: DataFrame, gone: DataFrame | None = None, generation: int | None = None) -> Index:
        """A generation of documents that are new or have changed (doc_id, text), and of others that are no more (doc_id).

        With its number the call may come again: one that is there already changes nothing.
        """
        known = self.generations()
        number = generation or len(known) + 1
        if number <= len(known):
            return self
        if number != len(known) + 1:
            raise ValueError(f"generation {len(known) + 1} is next")
        touched = changed.select(F.col("doc_id").cast("long").alias("doc_id"))
        if gone is not None:
            gone = gone.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().join(touched, "doc_id", "left_anti")
            touched = touched.union(gone)
        lost = self.live_docs().join(touched, "doc_id", "left_semi").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
        return self._write(changed, gone, {"generation": number, "n": known[-1]["n"] - lost.n, "words": known[-1]["words"] - lost.words})

    def live_docs(self) -> DataFrame:
        """(doc_id, size) of the documents as of the last generation."""
        last = self._read("docs", DOCS, self.generations()).groupBy("doc_id").agg(F.max_by(F.struct("size"), "generation").alias("s"))
        return last.filter("s.size is not null").select("doc_id", "s.size")

    def postings(self, terms: list[str]) -> DataFrame:
        """(term, doc_id, tf, size) of the terms, a short list: their buckets are read, and what later generations replaced is left out."""
        known = self.generations()
        wanted = sorted({r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(self._bucket(F.col("term"))).collect()})
        rows = self._read("postings", POSTINGS, known).filter(F.col("bucket").isin(wanted) & F.col("term").isin(terms))
        if len(known) > 1:
            later = self._read("docs", DOCS, known[1:]).groupBy("doc_id").agg(F.max("generation").alias("last"))
            rows = rows.join(later, "doc_id", "left").filter("last is null or generation = last")
        return rows.groupBy("term", "doc_id", "size").agg(F.sum("tf").cast("int").alias("tf")).select("term", "doc_id", "tf", "size")

    def bm25(self, queries: DataFrame, k1: float = 1.2, b: float = 0.75, most: int = 20) -> DataFrame:
        """(query_id, doc_id, score) of each query's best documents, as retrieval.bm25() over the texts. queries: query_id, term, a short list."""
        terms = [r.term for r in queries.select("term").distinct().collect()]
        last = self.generations()[-1]
        tf = self.postings(terms)
        df = tf.groupBy("term").agg(F.count("*").alias("df"))
        idf = F.log((F.lit(last["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        mean = last["words"] / last["n"] if last["n"] else 1.0
        part = F.when(idf > 0, idf).otherwise(1e-6) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / mean))
        total = tf.join(df, "term").withColumn("part", part).join(queries, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        return total.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= most).drop("k")
