"""Named queries of what is retrieved for a step: packets, postings, literal search, snippets, scopes. Each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import packets, postings, retrieval
from ..sources import tables as T
from ..sources.shared import Scratch
from .catalog import query

_ORIGIN = "CASE o_orderkey % 13 WHEN 0 THEN 'project_note' WHEN 1 THEN 'note' WHEN 2 THEN 'impact' WHEN 3 THEN 'anchor' WHEN 4 THEN 'anchor' WHEN 5 THEN 'explicit' ELSE 'graph' END"
_ITEM = f"""o_custkey div 10 AS packet, {_ORIGIN} AS origin, o_orderkey AS seq, o_totalprice AS score, CASE o_orderkey % 3 WHEN 0 THEN 'intent' WHEN 1 THEN 'observation' ELSE 'advice' END AS kind,
  CASE WHEN o_orderkey % 17 = 0 THEN 'source' END AS stale, o_orderkey % 40 AS node_id, CASE WHEN o_orderkey % 29 = 0 THEN 'other' ELSE 'main' END AS workspace, 'repo' AS repository,
  CASE WHEN o_orderkey % 31 = 0 THEN 'conf/.env.local' ELSE 'src/a.go' END AS path, CASE WHEN o_orderkey % 37 = 0 THEN '' ELSE 'h' END AS hash, 1 AS version, 8 + o_orderkey * 7919 % 400 AS cost"""
_BUDGET = "2000 + packet % 5 * 500"

_PACKETS = f"""WITH RECURSIVE i AS (SELECT {_ITEM.replace(' div ', ' // ')} FROM orders), b AS (SELECT *, {_BUDGET} AS budget, origin IN ('project_note', 'note') AS is_note FROM i),
  g AS (SELECT *, CASE WHEN is_note AND stale IS NOT NULL THEN 'stale' WHEN NOT is_note AND workspace <> 'main' THEN 'foreign' WHEN NOT is_note AND hash = '' THEN 'invalid' WHEN NOT is_note AND path LIKE '%/.env%' THEN 'sensitive' END AS v,
    list_position(['project_note', 'note', 'impact', 'anchor', 'explicit', 'graph'], origin) AS stage, CASE WHEN origin = 'note' THEN list_position(['intent', 'observation', 'advice'], kind) ELSE 0 END AS by_kind,
    CASE WHEN origin IN ('anchor', 'explicit', 'graph') THEN -score ELSE 0 END AS worse, CASE WHEN origin = 'note' THEN -seq ELSE seq END AS turn FROM b),
  r AS (SELECT *, v IS NULL AND NOT is_note AND node_id <> 0 AND row_number() OVER (PARTITION BY packet, CASE WHEN v IS NULL AND NOT is_note AND node_id <> 0 THEN node_id ELSE -seq - 1 END ORDER BY stage, by_kind, worse, turn) > 1 AS again FROM g),
  k AS (SELECT *, row_number() OVER (PARTITION BY packet ORDER BY stage, by_kind, worse, turn) AS k FROM r WHERE v IS NULL AND NOT again),
  f AS (SELECT packet, origin, seq, cost, budget, 0::BIGINT AS k, ''::VARCHAR AS verdict, 0::BIGINT AS used, 0::BIGINT AS pn, 0::BIGINT AS nt, 0::BIGINT AS gr FROM k WHERE k = 1
    UNION ALL SELECT x.packet, x.origin, x.seq, x.cost, x.budget, x.k, x.verdict, f.used + CASE WHEN x.verdict = 'kept' THEN x.cost ELSE 0 END, f.pn + CASE WHEN x.verdict = 'kept' AND x.origin = 'project_note' THEN x.cost ELSE 0 END,
      f.nt + CASE WHEN x.verdict = 'kept' AND x.origin = 'note' THEN x.cost ELSE 0 END, f.gr + CASE WHEN x.verdict = 'kept' AND x.origin = 'graph' THEN x.cost ELSE 0 END
    FROM f, LATERAL (SELECT k.*, CASE WHEN k.origin = 'project_note' AND f.pn + k.cost > floor(k.budget * 0.15::DOUBLE) THEN 'note_share' WHEN k.origin = 'note' AND f.nt + k.cost > floor(k.budget * 0.15::DOUBLE) THEN 'note_share'
      WHEN k.origin = 'graph' AND f.gr + k.cost > floor(k.budget * 0.33::DOUBLE) THEN 'graph_share' WHEN k.origin IN ('anchor', 'explicit', 'graph') AND f.used + k.cost > k.budget THEN 'budget' ELSE 'kept' END AS verdict FROM k WHERE k.packet = f.packet AND k.k = f.k + 1) x),
  assembled AS (SELECT packet, origin, seq, cost, coalesce(v, 'repeat') AS verdict, CAST(NULL AS BIGINT) AS used FROM r WHERE v IS NOT NULL OR again UNION ALL SELECT packet, origin, seq, cost, verdict, used FROM f WHERE k > 0) """


def _assembled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = T.table(spark, sf_dir, "orders").selectExpr(*_split(_ITEM))
    requests = items.select("packet").distinct().select("packet", F.lit("main").alias("workspace"), F.expr(_BUDGET).alias("budget"))
    return packets.assemble(items, requests), requests


def _split(columns: str) -> list[str]:
    """The expressions of a list of columns; none of them has a comma of its own."""
    return [c.strip() for c in columns.split(",")]


@query("packet_assembly", _PACKETS + "SELECT * FROM assembled")
def packet_assembly(spark, sf_dir):
    """R2: what becomes of every item of each customer group's packet."""
    return _assembled(spark, sf_dir)[0]


@query("packet_totals", _PACKETS + """SELECT packet, count_if(verdict = 'kept' AND origin NOT IN ('project_note', 'note'))::BIGINT AS slices, count_if(verdict = 'kept' AND origin IN ('project_note', 'note'))::BIGINT AS notes,
  coalesce(sum(cost) FILTER (verdict = 'kept'), 0)::BIGINT AS tokens, count_if(verdict IN ('sensitive', 'graph_share', 'budget'))::BIGINT AS dropped, count_if(verdict IN ('note_share', 'stale'))::BIGINT AS notes_dropped, count_if(verdict IN ('foreign', 'invalid'))::BIGINT AS rejected FROM assembled GROUP BY packet""")
def packet_totals(spark, sf_dir):
    """R2: slices, tokens and drop counters of each packet."""
    return packets.packet_totals(*_assembled(spark, sf_dir))


TERMS = ((1, "trash"), (1, "license"), (2, "clown"), (3, "copyright"))
_BM25 = f"""q(query_id, term) AS (VALUES {', '.join(map(str, TERMS))}), w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM live),
  z AS (SELECT count(*) AS n, avg(len(w)) AS a FROM w), t AS (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM w), tf AS (SELECT term, doc_id, size, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  s AS (SELECT query_id, doc_id, round(sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / a))), 6) AS score FROM tf JOIN df USING (term) JOIN q USING (term), z GROUP BY query_id, doc_id),
  best AS (SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS k FROM s) WHERE k <= 20)"""


def _terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TERMS), "query_id int, term string")


@query("bm25_refreshed", f"WITH live AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'license ' || text ELSE text END AS text FROM documents WHERE doc_id % 10 > 0), {_BM25} SELECT * FROM best")
def bm25_refreshed(spark, sf_dir):
    """Ranking after a second generation in which documents changed, and a third in which some are no more."""
    docs = T.table(spark, sf_dir, "documents").select("doc_id", "text")
    index = postings.Index(spark, Scratch(spark, "postings").path, 16).build(docs)
    index.refresh(docs.filter("doc_id % 9 = 0").withColumn("text", F.concat(F.lit("license "), "text")))
    index.refresh(docs.limit(0), docs.filter("doc_id % 10 = 0").select("doc_id"))
    return index.bm25(_terms(spark))


@query("snippets", f"""WITH live AS (SELECT doc_id, text FROM documents), {_BM25}, k AS (SELECT query_id, best.doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS t FROM best JOIN documents d ON d.doc_id = best.doc_id),
  i AS (SELECT query_id, doc_id, t, unnest(range(0, greatest(len(t) - 24, 0) + 1)) AS first FROM k), x AS (SELECT *, (SELECT list(term) FROM q WHERE q.query_id = i.query_id) AS terms FROM i),
  c AS (SELECT query_id, doc_id, t, first, len(list_filter(t[first + 1 : first + 24], lambda w: list_has_any(regexp_split_to_array(lower(w), '[^a-z0-9]+'), terms))) AS n FROM x WHERE first IN (0, greatest(len(t) - 24, 0)) OR list_has_any(regexp_split_to_array(lower(t[first + 1]), '[^a-z0-9]+'), terms))
  SELECT query_id, doc_id, CAST(first AS INTEGER) AS first, CASE WHEN first > 0 THEN '… ' ELSE '' END || array_to_string(t[first + 1 : first + 24], ' ') || CASE WHEN first + 24 < len(t) THEN ' …' ELSE '' END AS body
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY n DESC, first) AS k FROM c) WHERE k = 1""")
def snippets(spark, sf_dir):
    """the window of 24 tokens of each hit that has most of the query's terms."""
    docs = T.table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = postings.Index(spark, Scratch(spark, "postings").path, 16).build(docs).bm25(_terms(spark))
    return retrieval.snippets(docs, hits, _terms(spark))


PATTERNS = ((1, "@", False), (2, "license", True), (3, "the", True), (4, "a.*b", False), (5, "ion, ", False), (6, ". ", False), (7, "  ", False), (8, "The", False))


@query("grep", f"""WITH q(query_id, pattern, word) AS (VALUES {', '.join(str(p) for p in PATTERNS)}), f AS (SELECT 'src/' || source || '/' || doc_id || CASE WHEN doc_id % 7 = 0 THEN '.pem' ELSE '.txt' END AS path, string_split(coalesce(text, ''), chr(10)) AS t FROM documents WHERE doc_id % 7 > 0),
  l AS (SELECT path, unnest(t) AS text, generate_subscripts(t, 1) AS line FROM f), h AS (SELECT query_id, path, line, text FROM l, q WHERE trim(pattern) <> '' AND contains(text, pattern) AND (NOT word OR regexp_matches(text, '(^|[^A-Za-z0-9_])' || pattern || '($|[^A-Za-z0-9_])'))),
  n AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY path) AS file FROM h), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY path, line) AS place, count(*) OVER (PARTITION BY query_id) AS shown FROM n WHERE file <= 40),
  o AS (SELECT query_id, max(file) > 40 AS over FROM n GROUP BY query_id), r AS (SELECT k.*, CASE WHEN over THEN 'more than 40 files' WHEN shown > 200 THEN 'more than 200 matches' END AS reason FROM k JOIN o ON o.query_id = k.query_id WHERE place <= 200)
  SELECT query_id, path, CAST(line AS INTEGER) AS line, CASE WHEN length(text) > 300 THEN substring(text, 1, 300) || '…' ELSE text END AS text, reason IS NOT NULL AS truncated, reason FROM r""")
def grep(spark, sf_dir):
    """Fixed strings in all texts, up to 40 files and 200 lines a query."""
    i = F.col("doc_id")
    files = T.table(spark, sf_dir, "documents").select(F.concat(F.lit("src/"), "source", F.lit("/"), i, F.when(i % 7 == 0, ".pem").otherwise(".txt")).alias("path"), "text")
    return retrieval.grep(files, spark.createDataFrame(list(PATTERNS), "query_id int, pattern string, word boolean"))
