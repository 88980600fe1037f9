"""Named queries of the index of repositories, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import indexing
from ..sources import tables as T
from ..sources.shared import Scratch
from .catalog import query


def line_terms(contents: DataFrame) -> DataFrame:
    """A line declares the term that it begins with, and refers to the one that it ends with."""
    words = F.filter(F.split("line", "[^A-Za-z]+"), lambda w: w != "")
    lines = contents.select("hash", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).select("hash", (F.col("i") + 1).alias("n"), words.alias("w")).filter("size(w) > 0")
    none = lambda t: F.lit(None).cast(t)
    said = lambda fact, name, line, edge, evidence: F.struct(F.lit(fact).alias("fact"), F.lit("term").alias("kind"), name.alias("name"), line.cast("int").alias("line"), edge.alias("edge"), evidence.alias("evidence"))
    declared = said("declare", F.get("w", F.lit(0)), F.col("n"), none("string"), none("string"))
    # both of a line at once: a union would have the texts dealt for each
    return lines.select("hash", F.inline(F.array(declared, said("refer", F.element_at("w", -1), none("int"), F.lit("references"), F.lit("inferred")))))


def _files(spark: SparkSession, sf_dir: str, tail: str = "") -> DataFrame:
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(tail))
    docs = T.table(spark, sf_dir, "documents").select(F.col("source").alias("repository"), F.concat("lang", F.lit("/"), F.col("doc_id") % 3, F.lit("/"), "doc_id", F.lit(".md")).alias("path"), text.alias("text"))
    return docs.select("repository", "path", F.sha2("text", 256).alias("hash"), F.lit("markdown").alias("language"), F.octet_length("text").cast("long").alias("size"), "text")


def built(spark: SparkSession, sf_dir: str) -> indexing.Index:
    """The index of all sources, brought up to a change of one of them and the loss of another."""
    index = indexing.Index(spark, Scratch(spark, "index").path, (indexing.Analyzer("terms", ("markdown",), line_terms),))
    before = _files(spark, sf_dir)
    index.index(before)
    changed = _files(spark, sf_dir, "\nExtra line of Extra").filter("repository = 'src3'")
    index.index(before.filter("repository not in ('src3', 'src5')").unionByName(changed))
    return index


@query("index_pipeline", """WITH d AS (SELECT source AS repository, lang || '/' || doc_id % 3 || '/' || doc_id || '.md' AS path, coalesce(text, '') || CASE WHEN source = 'src3' THEN chr(10) || 'Extra line of Extra' ELSE '' END AS text FROM documents WHERE source <> 'src5'),
  t AS (SELECT repository, path, unnest(string_split(text, chr(10))) AS line FROM d), w AS (SELECT repository, path, list_filter(regexp_split_to_array(line, '[^A-Za-z]+'), lambda x: x <> '') AS w FROM t),
  terms AS (SELECT DISTINCT repository, w[1] AS name FROM w WHERE len(w) > 0), refs AS (SELECT DISTINCT repository, path, w[-1] AS name FROM w WHERE len(w) > 0),
  f AS (SELECT repository, string_split(repository || '/' || path, '/') AS p FROM d), l AS (SELECT DISTINCT repository, array_to_string(p[:i], '/') AS child, i, len(p) AS n FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM f)),
  rows AS (SELECT repository, 'file' AS what, 'markdown' AS kind FROM d UNION ALL SELECT repository, 'chunk', '' FROM (SELECT repository, unnest(range(0, (len(string_split(text, chr(10))) - 1) // 60 + 1)) FROM d)
    UNION ALL SELECT repository, 'node', CASE WHEN i = n THEN 'file' ELSE 'directory' END FROM l UNION ALL SELECT repository, 'node', 'term' FROM terms UNION ALL SELECT repository, 'edge', 'contains' FROM l WHERE i > 1
    UNION ALL SELECT repository, 'edge', 'references' FROM refs WHERE (repository, name) IN (SELECT repository, name FROM terms))
  SELECT repository, what, kind, count(*) AS n FROM rows GROUP BY ALL""")
def index_pipeline(spark, sf_dir):
    """Files, chunks, nodes and edges after a second run that made two sources anew."""
    index = built(spark, sf_dir)
    rows = index.files.read().select("repository", F.lit("file").alias("what"), F.col("language").alias("kind"))
    rows = rows.unionByName(index.chunks.read().select("repository", F.lit("chunk").alias("what"), F.lit("").alias("kind")))
    for name, table in (("node", index.nodes), ("edge", index.edges)):
        rows = rows.unionByName(table.read().select("repository", F.lit(name).alias("what"), "kind"))
    return rows.groupBy("repository", "what", "kind").agg(F.count("*").alias("n"))
