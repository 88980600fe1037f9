"""Named queries of lookups, reports and notes in the forms that users see, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import failures, graph, journal, matching, packets, packing, results
from ..sources import tables as T
from ..sources import trees
from ..sources.shared import Scratch
from . import catalog, journals, matches, reports, workflows  # noqa: F401  (their SQL is part of these)
from .catalog import query


@query("node_by_id", f"WITH {T.GRAPH_SQL} SELECT node_id, kind, fqn FROM nodes WHERE node_id IN (SELECT 3000000000 + l_suppkey * 7 FROM lineitem WHERE l_quantity < 3)")
def node_by_id(spark, sf_dir):
    """Nodes by the ids that are asked for."""
    asked = T.table(spark, sf_dir, "lineitem").filter("l_quantity < 3").select((F.col("l_suppkey") * 7 + 3_000_000_000).alias("node_id"))
    return T.nodes(spark, sf_dir).join(asked, "node_id", "left_semi")


@query("telemetry_counters_since", f"""WITH {T.TELEMETRY_SQL}, s AS (SELECT * FROM telemetry WHERE ts >= (SELECT min(ts) FROM telemetry) + INTERVAL 3 DAY), o AS (SELECT name, duration_ms, row_number() OVER (PARTITION BY name ORDER BY duration_ms) - 1 AS i, count(*) OVER (PARTITION BY name) AS c FROM s),
  mid AS (SELECT name, duration_ms AS p50 FROM o WHERE i = c // 2)
  SELECT s.name, kind, count(*) AS n, sum(duration_ms)::BIGINT AS total_ms, max(duration_ms) AS max_ms, round(sum(duration_ms) / count(*), 8) AS mean_ms, any_value(p50) AS p50 FROM s JOIN mid ON s.name = mid.name GROUP BY s.name, kind""")
def telemetry_counters_since(spark, sf_dir):
    """A3: counters from a point in time on, with their means; the median is of the name from there on, whatever the kind."""
    rows = T.telemetry(spark, sf_dir)
    rows = rows.filter(F.col("ts") >= rows.agg(F.min("ts") + F.expr("INTERVAL 3 DAYS")).scalar())
    counts = rows.groupBy("name", "duration_ms").agg(F.count("*").alias("c"))
    from pyspark.sql import Window

    placed = counts.withColumn("upto", F.sum("c").over(Window.partitionBy("name").orderBy("duration_ms"))).withColumn("all", F.sum("c").over(Window.partitionBy("name")))
    middle = placed.filter(F.col("upto") > F.floor(F.col("all") / 2)).groupBy("name").agg(F.min("duration_ms").alias("p50"))
    sums = rows.groupBy("name", "kind").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms"))
    return sums.join(middle, "name").withColumn("mean_ms", F.round(F.col("total_ms") / F.col("n"), 8))


@query("head_tail", """WITH l AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS t FROM documents)
  SELECT doc_id, sha256(CASE WHEN len(t) <= 13 THEN text ELSE array_to_string(list_concat(list_concat(t[:6], ['... ' || (len(t) - 10) || ' lines ...']), t[-4:]), chr(10)) END) AS body_sha256 FROM l""")
def head_tail(spark, sf_dir):
    """The first and last lines of long texts."""
    cut = packing.head_tail(F.coalesce("text", F.lit("")), 6, 4, 13)
    return T.table(spark, sf_dir, "documents").select("doc_id", F.sha2(cut, 256).alias("body_sha256"))


@query("shown_lines", """WITH d AS (SELECT doc_id AS file_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents), s AS (SELECT l_orderkey % 300 AS file_id, l_linenumber * 4 - 3 AS a, l_linenumber * 4 - 3 + l_partkey % 3 AS b FROM lineitem WHERE l_partkey % 50 = 0),
  x AS (SELECT file_id, t, unnest(t) AS line, generate_subscripts(t, 1) AS i FROM d), m AS (SELECT DISTINCT file_id FROM s),
  y AS (SELECT x.file_id, i, line, len(t) AS n, CASE WHEN x.file_id IN (SELECT file_id FROM m) THEN EXISTS (SELECT 1 FROM s WHERE s.file_id = x.file_id AND i BETWEEN a - 3 AND b + 3) ELSE i <= 20 END AS shown FROM x),
  z AS (SELECT *, coalesce(lag(shown) OVER (PARTITION BY file_id ORDER BY i), true) AS was FROM y)
  SELECT file_id, sha256(string_agg(CASE WHEN shown THEN i || ': ' || line ELSE '[lines left out]' END, chr(10) ORDER BY i)) AS body_sha256 FROM z WHERE shown OR was GROUP BY file_id""")
def shown_lines(spark, sf_dir):
    """Lines about spans, with marks where some are left out; files without a span show their first ones."""
    files = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "text")
    spans = T.table(spark, sf_dir, "lineitem").filter("l_partkey % 50 = 0").selectExpr("l_orderkey % 300 AS file_id", "l_linenumber * 4 - 3 AS first", "l_linenumber * 4 - 3 + l_partkey % 3 AS last")
    return matching.shown_lines(files, spans, first=20).select("file_id", F.sha2("body", 256).alias("body_sha256"))


@query("repo_map_ranked", f"""WITH RECURSIVE r AS ({catalog.oracle_sql()['pagerank']}), m AS (SELECT r.node_id, r.node_id // 1000000000 AS packet, length(fqn) // 3 + 20 AS cost, row_number() OVER (PARTITION BY r.node_id // 1000000000 ORDER BY score DESC, fqn) AS seq
    FROM r JOIN (WITH {T.GRAPH_SQL} SELECT * FROM nodes) n ON n.node_id = r.node_id WHERE kind IN ('nation', 'supplier', 'customer')),
  f AS (SELECT packet, seq, node_id, cost <= 900 AS fits, CASE WHEN cost <= 900 THEN cost ELSE 0 END AS used FROM m WHERE seq = 1
  UNION ALL SELECT m.packet, m.seq, m.node_id, f.used + m.cost <= 900, CASE WHEN f.used + m.cost <= 900 THEN f.used + m.cost ELSE f.used END FROM f JOIN m ON m.packet = f.packet AND m.seq = f.seq + 1)
  SELECT packet, node_id, used FROM f WHERE fits""")
def repo_map_ranked(spark, sf_dir):
    """Declarations by PageRank, best first, as many as fit each kind's budget."""
    from pyspark.sql import Window

    scores = graph.pagerank(T.nodes(spark, sf_dir), T.edges(spark, sf_dir)).select("node_id", F.round("score", 9).alias("score"))
    nodes = T.nodes(spark, sf_dir).filter("kind in ('nation', 'supplier', 'customer')").join(scores, "node_id")
    best = (F.desc("score"), F.col("fqn"))
    nodes = packing.could_fit(nodes.withColumn("packet", F.expr("node_id div 1000000000")).withColumn("cost", packets.map_entry_tokens(F.col("fqn"))), 900, *best)
    ranked = Scratch(spark, "ranked").write(nodes.withColumn("seq", F.row_number().over(Window.partitionBy("packet").orderBy(*best)).cast("long")), "ranked")
    return packing.greedy_fill(ranked, 900).join(ranked.select("packet", "seq", "node_id"), ["packet", "seq"]).select("packet", "node_id", "used")


@query("note_staleness", """WITH n AS (SELECT doc_id AS note_id, CASE WHEN doc_id % 7 = 0 THEN 'other' ELSE 'main' END AS repository, CASE WHEN doc_id % 11 > 0 THEN 'c' END AS commit, CASE doc_id % 5 WHEN 0 THEN 'user' WHEN 1 THEN 'tool' WHEN 2 THEN 'model' ELSE 'model_accepted' END AS source,
    list_filter(regexp_split_to_array(left(coalesce(text, ''), 40), '[^A-Za-z]+'), lambda x: length(x) > 5) AS symbols FROM documents), k AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS name FROM benchmark),
  l AS (SELECT note_id, max(s) AS lost FROM (SELECT note_id, unnest(symbols) AS s FROM n) WHERE s NOT IN (SELECT name FROM k) GROUP BY note_id)
  SELECT n.note_id, CASE WHEN lost IS NOT NULL THEN 'symbol:' || lost WHEN source = 'model' THEN 'source' WHEN repository <> 'main' OR commit IS NULL THEN 'provenance' END AS stale FROM n LEFT JOIN l ON l.note_id = n.note_id""")
def note_staleness(spark, sf_dir):
    """Why notes no longer count; the known symbols are the words of the benchmark."""
    i = F.col("doc_id")
    words = F.filter(F.split(F.substring(F.coalesce("text", F.lit("")), 1, 40), "[^A-Za-z]+"), lambda w: F.length(w) > 5)
    source = F.when(i % 5 == 0, "user").when(i % 5 == 1, "tool").when(i % 5 == 2, "model").otherwise("model_accepted")
    notes = T.table(spark, sf_dir, "documents").select(i.alias("note_id"), F.when(i % 7 == 0, "other").otherwise("main").alias("repository"), F.when(i % 11 > 0, "c").alias("commit"), F.lit(1).cast("long").alias("updated_at"), source.alias("source"), words.alias("symbols"))
    known = T.table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "[^A-Za-z]+")).alias("name"))
    return packets.stale_notes(notes, "main", known).select("note_id", "stale")


@query("rate_texts", f"""WITH {T.RUNS_SQL}, n AS (SELECT task_id, count_if(error IS NULL)::BIGINT AS n, count_if(error IS NULL AND solved)::BIGINT AS k FROM runs GROUP BY task_id), p AS (SELECT *, k::DOUBLE / n AS r FROM n), w AS (SELECT *, 1.96 * sqrt(r * (1 - r) / n + 3.8416 / (4.0 * n * n)) AS reach FROM p)
  SELECT task_id, CASE WHEN n = 0 THEN '—' ELSE printf('%.0f', r * 100) || '% (' || k || '/' || n || ') [' || printf('%.0f', 100 * greatest(0.0, least(1.0, (r + 3.8416 / (2.0 * n) - reach) / (1 + 3.8416 / n)))) || '–' || printf('%.0f', 100 * greatest(0.0, least(1.0, (r + 3.8416 / (2.0 * n) + reach) / (1 + 3.8416 / n)))) || '%]' END AS rate FROM w""")
def rate_texts(spark, sf_dir):
    """rates with their bounds as a report says them."""
    counts = T.runs(spark, sf_dir).groupBy("task_id").agg(F.count_if(~results.errored()).alias("n"), F.count_if(~results.errored() & F.col("solved")).alias("k"))
    return counts.select("task_id", results.rate_text(F.col("k"), F.col("n")).alias("rate"))


@query("json_summaries", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'k=' || json_extract_string(props, '$.k') WHEN 1 THEN 'a[2]  b={…}  c=true  k=' || json_extract_string(props, '$.k') || '  s=' || event_type || ' x' WHEN 2 THEN '' ELSE 'no json: ' || event_type END AS line FROM events""".replace("b={…}", "b{…}"))
def json_summaries(spark, sf_dir):
    """recorded objects on one line each."""
    k = F.get_json_object("props", "$.k")
    rich = F.concat(F.lit('{"s":" '), "event_type", F.lit('\\nx ","k":'), k, F.lit(',"c":true,"b":{"z":1},"a":[1,{"y":2}]}'))
    text = F.when(F.col("event_id") % 4 == 0, F.col("props")).when(F.col("event_id") % 4 == 1, rich).when(F.col("event_id") % 4 == 2, "null").otherwise(F.concat(F.lit(" no json: "), "event_type"))
    return T.table(spark, sf_dir, "events").select("event_id", results.json_summary(text).alias("line"))


@query("lease_counts", f"WITH l AS ({catalog.oracle_sql()['lease_log']}), s AS (SELECT worktree, arg_max(CASE WHEN holder IS NULL THEN -1 ELSE expires END, seq) AS e FROM l GROUP BY worktree) SELECT count_if(e > 1704600000)::BIGINT AS live, count_if(e BETWEEN 0 AND 1704600000)::BIGINT AS expired FROM s")
def lease_counts(spark, sf_dir):
    """Leases as their log leaves them, by whether they still run at a time."""
    log = catalog.queries()["lease_log"](spark, sf_dir)
    return journal.lease_counts(journal.latest(log, ["worktree"], ["seq"]), 1_704_600_000)


@query("miss_rate", f"WITH m AS ({catalog.oracle_sql()['misses_anti']}) SELECT count(*) AS misses, (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_returnflag = 'R') AS packets, round(count(*) / (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_returnflag = 'R'), 8) AS rate FROM m")
def miss_rate(spark, sf_dir):
    """What packets did not carry, by packet; 0 without any packet."""
    packets_ = T.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").agg(F.countDistinct("l_suppkey").alias("packets"))
    rows = catalog.queries()["misses_anti"](spark, sf_dir).agg(F.count("*").alias("misses")).select("misses", packets_.scalar().alias("packets"))
    return rows.withColumn("rate", F.when(F.col("packets") > 0, F.round(F.col("misses") / F.col("packets"), 8)).otherwise(0.0))


@query("reference_owners", """WITH s AS (SELECT o_orderkey AS span_id, o_custkey AS file_id, o_orderkey % 1000 AS a, o_orderkey % 1000 + o_orderkey % 401 AS b FROM orders),
  p AS (SELECT l_orderkey * 10 + l_linenumber AS point_id, min(l_suppkey) AS file_id, min(l_partkey) % 1000 AS line, min(l_orderkey) AS target FROM lineitem GROUP BY 1)
  SELECT point_id, arg_min(span_id, (b - a) * 1000000000 + span_id) AS span_id FROM p LEFT JOIN s ON p.file_id = s.file_id AND line BETWEEN a AND b AND span_id <> target GROUP BY 1""")
def reference_owners(spark, sf_dir):
    """The innermost declaration about each reference that is not its target; none stands for the file."""
    key = F.col("o_orderkey") % 1000
    spans = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("span_id"), F.col("o_custkey").alias("file_id"), key.alias("first"), (key + F.col("o_orderkey") % 401).alias("last"))
    points = T.table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point_id")).agg(F.min("l_suppkey").alias("file_id"), (F.min("l_partkey") % 1000).alias("line"), F.min("l_orderkey").alias("target"))
    return matching.innermost_span(points, spans)


@query("commit_log", """WITH p AS (SELECT l_orderkey, list_sort(list(DISTINCT 'src/p' || l_partkey % 90 || '.go')) AS paths FROM lineitem GROUP BY l_orderkey)
  SELECT 'h' || o_orderkey AS hash, 'a' || o_custkey AS author, epoch(o_orderdate)::BIGINT AS "at", o_orderpriority || ' x' AS subject, coalesce(array_to_string(paths, ','), '') AS paths FROM orders LEFT JOIN p ON l_orderkey = o_orderkey""")
def commit_log(spark, sf_dir):
    """Orders as a version log, written and read again, with the paths that each touches."""
    paths = T.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit("src/p"), F.col("l_partkey") % 90, F.lit(".go"))).alias("paths"))
    orders = T.table(spark, sf_dir, "orders").join(paths, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    fields = [F.concat(F.lit("h"), "o_orderkey"), F.concat(F.lit("a"), "o_custkey"), F.unix_timestamp("o_orderdate").cast("string"), F.concat("o_orderpriority", F.lit(" x")), F.concat(F.lit("\n"), F.coalesce(F.array_join("paths", "\n"), F.lit("")), F.lit("\n"))]
    folder = Scratch(spark, "log").path
    orders.select(F.concat_ws(trees.FIELD, *fields).alias("value")).write.option("lineSep", trees.RECORD).text(folder)
    return trees.commits(spark, folder).withColumn("paths", F.array_join(F.array_sort("paths"), ","))


@query("lint_findings", """SELECT DISTINCT user_id AS report, event_type AS linter, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'warning' END AS severity, 'f' || event_id % 5 || '.go' AS file, event_id % 7 AS line, 0::BIGINT AS col, 'finding ' || event_id % 11 AS message FROM events WHERE event_id % 4 > 0""")
def lint_findings(spark, sf_dir):
    """findings of linters' JSON reports, a report a user; a quarter of the issues is in reports that break off."""
    i = F.col("event_id")
    place = F.struct(F.concat(F.lit("f"), i % 5, F.lit(".go")).alias("Filename"), (i % 7).alias("Line"))
    issue = F.struct(F.col("event_type").alias("FromLinter"), F.when(i % 3 > 0, "warning").alias("Severity"), F.concat(F.lit("finding "), i % 11).alias("Text"), place.alias("Pos"))
    text = F.to_json(F.struct(F.array(issue).alias("Issues")))
    reports = T.table(spark, sf_dir, "events").select(F.col("user_id").alias("report"), F.when(i % 4 == 0, F.substring(text, 2, 20)).otherwise(text).alias("text"))
    return failures.linter_findings(reports)


@query("crash_counts", "SELECT user_id AS log, CASE event_type WHEN 'error' THEN 'panic' ELSE 'race' END AS kind, count(*) AS n FROM events WHERE event_type IN ('error', 'signup') GROUP BY ALL")
def crash_counts(spark, sf_dir):
    """races and panics that logs report."""
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("  panic: "), "event_id")).when(F.col("event_type") == "signup", "WARNING: DATA RACE").otherwise("no panic: here")
    return failures.crashes(T.table(spark, sf_dir, "events").select(F.col("user_id").alias("log"), text.alias("text")))


_FILTERS = ((None, None, None), ("2024-01-03", None, None), (None, "k3", None), ("2024-01-02", "k4", 2))


def _filter_sql(i: int, since: str | None, name: str | None, workspace: int | None) -> str:
    parts = [*([f"day >= '{since}'"] if since else []), *([f"name = '{name}'"] if name else []), *([f"workspace_id = {workspace}"] if workspace is not None else [])]
    return f"SELECT {i} AS filter, workspace_id, kind, name, sum(n)::BIGINT AS n, sum(total_ms)::BIGINT AS total_ms FROM d WHERE {' AND '.join(parts) or 'true'} GROUP BY ALL"


@query("telemetry_filtered", f"WITH d AS ({catalog.oracle_sql()['telemetry_daily']}) " + " UNION ALL ".join(_filter_sql(i, *f) for i, f in enumerate(_FILTERS)))
def telemetry_filtered(spark, sf_dir):
    """Totals of the daily counts under filters that may each be left out."""
    daily = catalog.queries()["telemetry_daily"](spark, sf_dir)
    out = None
    for i, f in enumerate(_FILTERS):
        part = journal.totals(daily, *f).select(F.lit(i).alias("filter"), "workspace_id", "kind", "name", "n", "total_ms")
        out = part if out is None else out.unionByName(part)
    return out
