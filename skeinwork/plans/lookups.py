"""Named queries of lookups, histories, trees and lexical search, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph, journal, packing, retrieval
from ..sources import tables as T
from . import catalog, reports
from .catalog import query

GREP = ((1, "trash"), (1, "license"), (2, "the"), (2, "clown"), (3, "nosuchword"))
_GREP = "q(query_id, term) AS (VALUES " + ", ".join(map(str, GREP)) + ")"
_HITS = f"""{_GREP}, l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS b FROM documents), n AS (SELECT doc_id, unnest(range(1, len(b) + 1)) AS line, unnest(b) AS body FROM l),
  w AS (SELECT doc_id, line, unnest(list_distinct(regexp_split_to_array(body, '[^A-Za-z0-9_]+'))) AS term FROM n), hits AS (SELECT query_id, doc_id, line, w.term FROM w JOIN q ON w.term = q.term)"""


def _hits(spark, sf_dir):
    return retrieval.word_hits(T.table(spark, sf_dir, "documents"), spark.createDataFrame(list(GREP), "query_id int, term string"))


@query("word_hits", f"WITH {_HITS} SELECT * FROM hits")
def word_hits(spark, sf_dir):
    """Every line of every document that has a term as a whole word."""
    return _hits(spark, sf_dir).withColumn("line", F.col("line").cast("long"))


@query("lexical_files", f"WITH {_HITS}, c AS (SELECT query_id, doc_id, count(*) AS n FROM hits GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, doc_id) AS k, count(*) OVER (PARTITION BY query_id) > 20 AS truncated FROM c) SELECT query_id, doc_id, n, truncated FROM r WHERE k <= 20")
def lexical_files(spark, sf_dir):
    """The twenty files with most hits, and whether there are more."""
    return retrieval.lexical_files(_hits(spark, sf_dir))


@query("expanded_terms", """WITH w AS (SELECT row_number() OVER () AS id, conv_id, turn, list_filter(regexp_split_to_array(coalesce(text, ''), '[^A-Za-z0-9_]+'), lambda x: x <> '') AS w FROM conversations), i AS (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
  p AS (SELECT id, len(w) + 3 * i AS pos, lower(w[i]) AS a, lower(w[i + 1]) AS b FROM i WHERE i < len(w) AND length(w[i]) > 1 AND length(w[i + 1]) > 1),
  t AS (SELECT id, i AS pos, w[i] AS term FROM i UNION ALL SELECT id, pos, a || upper(b[1]) || b[2:] FROM p UNION ALL SELECT id, pos + 1, a || '_' || b FROM p UNION ALL SELECT id, pos + 2, upper(a[1]) || a[2:] || upper(b[1]) || b[2:] FROM p),
  d AS (SELECT id, term, min(pos) AS pos FROM t WHERE length(term) >= 3 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS k FROM d), g AS (SELECT id, string_agg(term, ' ' ORDER BY pos) AS terms FROM r WHERE k <= 12 GROUP BY id)
  SELECT conv_id, turn, coalesce(terms, '') AS terms FROM w LEFT JOIN g ON g.id = w.id""")
def expanded_terms(spark, sf_dir):
    """search terms of every turn."""
    return T.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(retrieval.expanded_terms(F.coalesce("text", F.lit(""))), " ").alias("terms"))


@query("node_lookup", f"WITH {T.GRAPH_SQL} SELECT node_id, kind, fqn FROM nodes WHERE kind IN ('nation', 'customer') AND fqn IN (SELECT fqn FROM nodes WHERE node_id % 2 = 0) ORDER BY kind, fqn LIMIT 100")
def node_lookup(spark, sf_dir):
    """Nodes by name and kind, the first hundred."""
    nodes = T.nodes(spark, sf_dir)
    return graph.by_name(nodes, nodes.filter("node_id % 2 = 0").select("fqn"), ["nation", "customer"])


@query("graph_totals", f"WITH {T.GRAPH_SQL} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM nation WHERE n_nationkey % 5 = 0) AS dirty")
def graph_totals(spark, sf_dir):
    """A1: nodes, edges and dirty scopes."""
    dirty = T.table(spark, sf_dir, "nation").filter("n_nationkey % 5 = 0")
    return T.nodes(spark, sf_dir).agg(F.count("*").alias("nodes")).select("nodes", T.edges(spark, sf_dir).agg(F.count("*")).scalar().alias("edges"), dirty.agg(F.count("*")).scalar().alias("dirty"))


@query("nearest_edge", f"WITH {T.GRAPH_SQL} SELECT dst, src, kind, rank FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY rank, src, kind) AS k FROM edges) WHERE k = 1")
def nearest_edge(spark, sf_dir):
    """The edge of best evidence into each node; an aggregate, so a hub is combined before it is shuffled."""
    return T.edges(spark, sf_dir).groupBy("dst").agg(F.min(F.struct("rank", "src", "kind")).alias("e")).select("dst", "e.src", "e.kind", "e.rank")


@query("impact_public", reports._IMPACT + ", c AS (SELECT verdict, count_if(node_id % 7 <> 0)::BIGINT AS n, sum(count_if(node_id % 7 = 0)) OVER () > 0 AS truncated FROM judged GROUP BY verdict) SELECT * FROM c WHERE n > 0")
def impact_public(spark, sf_dir):
    """Consumers by verdict without the hidden ones."""
    return graph.public_impact(catalog.queries()["impact_report"](spark, sf_dir), F.col("node_id") % 7 == 0)


_PATH = "p_brand || '/' || replace(p_type, ' ', '/') || '/' || p_partkey"


@query("file_tree", f"""WITH f AS (SELECT string_split({_PATH}, '/') AS p FROM part), l AS (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM f)
  SELECT DISTINCT array_to_string(p[:i - 1], '/') AS parent, array_to_string(p[:i], '/') AS child, CASE WHEN i = len(p) THEN 'file' ELSE 'directory' END AS kind FROM l""")
def file_tree(spark, sf_dir):
    """Directories, files and what contains them."""
    return graph.file_tree(T.table(spark, sf_dir, "part").select(F.expr(_PATH).alias("path")))


@query("node_history", """WITH n AS (SELECT p_partkey AS node_id FROM part WHERE p_size > 25 ORDER BY p_partkey LIMIT 5), t AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_partkey IN (SELECT node_id FROM n))
  SELECT node_id, commit_id, "at" FROM (SELECT l_partkey AS node_id, l_orderkey AS commit_id, o_orderdate AS "at", row_number() OVER (PARTITION BY l_partkey ORDER BY o_orderdate DESC, l_orderkey DESC) AS k FROM t JOIN orders ON o_orderkey = l_orderkey) WHERE k <= 10""")
def node_history(spark, sf_dir):
    """The newest commits of the first matching nodes."""
    part, orders = T.table(spark, sf_dir, "part"), T.table(spark, sf_dir, "orders")
    touches = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("node_id"))
    return graph.history(part.filter("p_size > 25").select(F.col("p_partkey").alias("node_id")), touches, orders.select(F.col("o_orderkey").alias("commit_id"), F.col("o_orderdate").alias("at")))


@query("node_files", "SELECT s_suppkey AS node_id, s_name AS name, coalesce(c_custkey, 0) AS file_id, coalesce(c_name, '') AS path FROM supplier LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = s_suppkey * 3")
def node_files(spark, sf_dir):
    """Nodes with their file, 0 and '' where they have none."""
    files = T.table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("file_id"), F.col("c_name").alias("path"))
    nodes = T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node_id"), F.col("s_name").alias("name"))
    return nodes.join(files, F.col("file_id") == F.col("node_id") * 3, "left").select("node_id", "name", F.coalesce("file_id", F.lit(0)).alias("file_id"), F.coalesce("path", F.lit("")).alias("path"))


@query("hit_sources", f"SELECT query_id, h.doc_id, score, source, quality FROM ({catalog.oracle_sql()['bm25']}) h JOIN documents d ON d.doc_id = h.doc_id JOIN labels l ON l.doc_id = h.doc_id")
def hit_sources(spark, sf_dir):
    """Ranked hits with what they come from, by two equal-key joins on twenty hits a query."""
    hits = catalog.queries()["bm25"](spark, sf_dir)
    return hits.join(T.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").join(T.table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").select("query_id", "doc_id", "score", "source", "quality")


@query("repo_map", f"""WITH RECURSIVE {T.GRAPH_SQL}, d AS (SELECT dst, count(*) AS n FROM edges GROUP BY dst),
  m AS (SELECT node_id // 1000000000 AS packet, node_id, length(fqn) // 3 + 20 AS cost, row_number() OVER (PARTITION BY node_id // 1000000000 ORDER BY coalesce(n, 0) DESC, node_id) AS seq FROM nodes LEFT JOIN d ON dst = node_id WHERE kind IN ('region', 'nation', 'supplier')),
  f AS (SELECT packet, seq, node_id, cost <= 400 AS fits, CASE WHEN cost <= 400 THEN cost ELSE 0 END AS used FROM m WHERE seq = 1
  UNION ALL SELECT m.packet, m.seq, m.node_id, f.used + m.cost <= 400, CASE WHEN f.used + m.cost <= 400 THEN f.used + m.cost ELSE f.used END FROM f JOIN m ON m.packet = f.packet AND m.seq = f.seq + 1)
  SELECT packet, node_id, used FROM f WHERE fits""")
def repo_map(spark, sf_dir):
    """Nodes by how much depends on them, as many as fit each kind's budget."""
    degree = T.edges(spark, sf_dir).groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("n"))
    nodes = T.nodes(spark, sf_dir).filter("kind in ('region', 'nation', 'supplier')").join(degree, "node_id", "left")
    most = (F.desc(F.coalesce("n", F.lit(0))), F.col("node_id"))
    nodes = packing.could_fit(nodes.withColumn("packet", F.expr("node_id div 1000000000")).withColumn("cost", F.expr("length(fqn) div 3 + 20")), 400, *most)
    ranked = nodes.withColumn("seq", F.row_number().over(Window.partitionBy("packet").orderBy(*most)).cast("long"))
    return packing.greedy_fill(ranked, 400).join(ranked.select("packet", "seq", "node_id"), ["packet", "seq"]).select("packet", "node_id", "used")


@query("last_verification", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def last_verification(spark, sf_dir):
    """The newest verification of each task."""
    rows = T.table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("user_id", "event_id", "ts", "value")
    return journal.latest(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("user_decisions", "SELECT user_id, event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 = 3")
def user_decisions(spark, sf_dir):
    """Entries by a field of their JSON."""
    return T.table(spark, sf_dir, "events").filter(F.get_json_object("props", "$.k").cast("long") % 10 == 3).select("user_id", "event_id")
