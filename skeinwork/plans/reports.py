"""Named queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evalstats, graph, postings, results, retrieval
from ..sources import tables as T
from ..sources.shared import Scratch
from .catalog import query

START = 2_000_000_000  # the first nation


def _start(spark: SparkSession, node: int = START) -> DataFrame:
    return spark.range(1).select(F.lit(node).cast("long").alias("node_id"))


def _levels(depth: int, reverse: bool, start: int = START, where: str = "true") -> str:
    here, there = ("dst", "src") if reverse else ("src", "dst")
    out = f"l0 AS (SELECT CAST({start} AS BIGINT) AS node_id, 0 AS depth, 0 AS rank, CAST(NULL AS VARCHAR) AS via)"
    for d in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT node_id FROM l{i}" for i in range(d))
        out += f""", c{d} AS (SELECT e.{there} AS node_id, greatest(e.rank, f.rank) AS rank, e.kind AS via FROM edges e JOIN l{d - 1} f ON e.{here} = f.node_id
            WHERE {where} AND e.{there} NOT IN ({seen})), l{d} AS (SELECT node_id, {d} AS depth, rank, via FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY rank, via) AS k FROM c{d}) WHERE k = 1)"""
    return out + ", reached AS (" + " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(depth + 1)) + ")"


@query("graph_traverse_rev", f"WITH {T.GRAPH_SQL}, {_levels(3, True)} SELECT * FROM reached")
def graph_traverse_rev(spark, sf_dir):
    return graph.traverse(T.edges(spark, sf_dir), _start(spark), 3, reverse=True)


@query("graph_neighbors", f"WITH {T.GRAPH_SQL} SELECT src, dst, kind, rank FROM edges WHERE dst = {START}")
def graph_neighbors(spark, sf_dir):
    return graph.neighbours(T.edges(spark, sf_dir), START, reverse=True)


@query("graph_stats", f"WITH {T.GRAPH_SQL} SELECT kind, rank, count(*) AS n FROM edges GROUP BY kind, rank")
def graph_stats(spark, sf_dir):
    return T.edges(spark, sf_dir).groupBy("kind", "rank").agg(F.count("*").alias("n"))


_IMPACT = f"""WITH {T.GRAPH_SQL}, {_levels(3, True)}, judged AS (SELECT r.node_id, n.kind, n.fqn, depth, rank, via,
  CASE WHEN rank > 1 THEN 'undetermined' WHEN via IN ('calls', 'returns', 'accepts', 'implements', 'tests') THEN 'breaking' ELSE 'compiles' END AS verdict
  FROM reached r JOIN nodes n ON r.node_id = n.node_id WHERE depth > 0) """


@query("impact_report", _IMPACT + "SELECT * FROM judged")
def impact_report(spark, sf_dir):
    return graph.impact(T.edges(spark, sf_dir), T.nodes(spark, sf_dir), _start(spark), "signature")


@query("impact_counts", _IMPACT + "SELECT verdict, count(*) AS n FROM judged GROUP BY verdict")
def impact_counts(spark, sf_dir):
    return impact_report(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("n"))


def _rank_sql(rounds: int) -> str:
    m = "AS MATERIALIZED"
    out = f", deg {m} (SELECT src, count(*) AS degree FROM edges GROUP BY src), base {m} (SELECT node_id, coalesce(degree, 0) AS degree, (SELECT count(*) FROM nodes) AS n FROM nodes LEFT JOIN deg ON node_id = src), s0 {m} (SELECT *, 1.0::DOUBLE / n AS score FROM base)"
    for i in range(rounds):
        out += f""", g{i} {m} (SELECT e.dst AS node_id, sum(s.score / s.degree) AS got FROM edges e JOIN s{i} s ON e.src = s.node_id GROUP BY e.dst),
          s{i + 1} {m} (SELECT b.*, 0.15::DOUBLE / b.n + 0.85::DOUBLE * (coalesce(got, 0) + (SELECT sum(CASE WHEN degree = 0 THEN score ELSE 0 END) FROM s{i}) / b.n) AS score FROM base b LEFT JOIN g{i} g ON b.node_id = g.node_id)"""
    return f"WITH {T.GRAPH_SQL}{out} SELECT node_id, round(score, 9) AS score FROM s{rounds}"


@query("pagerank", _rank_sql(40))
def pagerank(spark, sf_dir):
    return graph.pagerank(T.nodes(spark, sf_dir), T.edges(spark, sf_dir)).select("node_id", F.round("score", 9).alias("score"))


@query("graph_traverse_fwd", f"WITH {T.GRAPH_SQL}, {_levels(3, False, 5_000_000_001)} SELECT * FROM reached")
def graph_traverse_fwd(spark, sf_dir):
    return graph.traverse(T.edges(spark, sf_dir), _start(spark, 5_000_000_001), 3)


_SOME = "e.kind IN ('uses_type', 'calls') AND e.rank IN (0, 1, 2)"


@query("graph_traverse_kinds", f"WITH {T.GRAPH_SQL}, {_levels(3, True, where="e.kind IN ('uses_type', 'calls') AND e.rank IN (0, 1, 2)")} SELECT * FROM reached")
def graph_traverse_kinds(spark, sf_dir):
    return graph.traverse(T.edges(spark, sf_dir), _start(spark), 3, reverse=True, kinds=["uses_type", "calls"], ranks=[0, 1, 2])


@query("graph_capped", f"WITH {T.GRAPH_SQL}, {_levels(3, True)} SELECT *, (SELECT count(*) FROM reached) > 25 AS truncated FROM reached ORDER BY depth, node_id LIMIT 25")
def graph_capped(spark, sf_dir):
    """The walk itself stops at 25 nodes, over edges stored by both ends."""
    stored = graph.Adjacency(spark, Scratch(spark, "adjacency").path, 16).write(T.edges(spark, sf_dir))
    found = graph.walk(stored, _start(spark), 3, reverse=True, most=25)
    return found.reached.withColumn("truncated", F.lit(found.truncated))


_RULES = ", ".join(str(r) for r in graph.RULES)
_DEFAULTS = ", ".join(str((c, *d)) for c, d in graph.DEFAULTS.items())
_JUDGED = f"""WITH {T.GRAPH_SQL}, {_levels(3, True)}, named(change, via, v, s) AS (VALUES {_RULES}), rest(change, dv, ds) AS (VALUES {_DEFAULTS}),
  judged AS (SELECT rest.change, r.node_id, n.kind, n.fqn, depth, rank, r.via, CASE WHEN rank > 1 THEN 'undetermined' ELSE coalesce(v, dv) END AS verdict,
    CASE WHEN rank > 1 THEN 'check by hand: evidence is ' || ['resolved', 'declared', 'inferred', 'observed', 'unknown'][rank + 1] ELSE coalesce(s, ds) END AS step
  FROM reached r JOIN nodes n ON r.node_id = n.node_id CROSS JOIN rest LEFT JOIN named ON named.change = rest.change AND named.via = r.via WHERE depth > 0) """


@query("impact_changes", _JUDGED + "SELECT change, via, verdict, step, count(*) AS n FROM judged GROUP BY ALL")
def impact_changes(spark, sf_dir):
    """what each kind of change means for the consumers of one nation."""
    reached = graph.traverse(T.edges(spark, sf_dir), _start(spark), 3, reverse=True).filter("depth > 0")
    changes = spark.createDataFrame([(c,) for c in graph.DEFAULTS], "change string")
    return graph.judged(reached, changes).groupBy("change", "via", "verdict", "step").agg(F.count("*").alias("n"))


@query("impact_lines", _JUDGED + f""", m AS (SELECT * FROM judged WHERE change = 'route' QUALIFY row_number() OVER (ORDER BY depth, node_id) <= 399),
  p AS (SELECT *, kind || '/' || node_id % 7 AS path FROM m)
  SELECT row_number() OVER (ORDER BY list_position(['breaking', 'undetermined', 'compiles', 'compatible'], verdict), depth, path, fqn, node_id) AS place, verdict, depth, path, fqn, kind, node_id, via,
    ['resolved', 'declared', 'inferred', 'observed', 'unknown'][rank + 1] AS evidence, step, (SELECT count(*) FROM reached) > 400 AS truncated, '{graph.CAVEAT}' AS caveat FROM p""")
def impact_lines(spark, sf_dir):
    """The report in the order in which it is read, of at most 400 nodes with the start."""
    nodes = T.nodes(spark, sf_dir).withColumn("path", F.concat("kind", F.lit("/"), (F.col("node_id") % 7).cast("string")))
    return graph.impact_lines(T.edges(spark, sf_dir), nodes, _start(spark), "route", most=400)


@query("telemetry_daily", f"WITH {T.TELEMETRY_SQL} SELECT workspace_id, strftime(ts, '%Y-%m-%d') AS day, kind, name, CAST(sum(n) AS BIGINT) AS n, CAST(sum(duration_ms) AS BIGINT) AS total_ms FROM telemetry GROUP BY ALL")
def telemetry_daily(spark, sf_dir):
    return T.telemetry(spark, sf_dir).groupBy("workspace_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "kind", "name").agg(F.sum("n").alias("n"), F.sum("duration_ms").alias("total_ms"))


@query("telemetry_totals", f"WITH {T.TELEMETRY_SQL} SELECT workspace_id, kind, name, CAST(sum(n) AS BIGINT) AS n, CAST(sum(duration_ms) AS BIGINT) AS total_ms FROM telemetry GROUP BY ALL")
def telemetry_totals(spark, sf_dir):
    return telemetry_daily(spark, sf_dir).groupBy("workspace_id", "kind", "name").agg(F.sum("n").alias("n"), F.sum("total_ms").alias("total_ms"))


@query("telemetry_counters", f"""WITH {T.TELEMETRY_SQL}, ordered AS (SELECT name, duration_ms, row_number() OVER (PARTITION BY name ORDER BY duration_ms) - 1 AS i, count(*) OVER (PARTITION BY name) AS c FROM telemetry),
  mid AS (SELECT name, duration_ms AS p50 FROM ordered WHERE i = c // 2)
  SELECT t.name, kind, count(*) AS n, CAST(sum(duration_ms) AS BIGINT) AS total_ms, max(duration_ms) AS max_ms, any_value(p50) AS p50 FROM telemetry t JOIN mid ON t.name = mid.name GROUP BY t.name, kind""")
def telemetry_counters(spark, sf_dir):
    """Counters by (name, kind); p50 is the upper median of the name, whatever the kind."""
    rows = T.telemetry(spark, sf_dir)
    # durations are few values: counts of each make the median without gathering rows
    counts = rows.groupBy("name", "duration_ms").agg(F.count("*").alias("c"))
    order = Window.partitionBy("name").orderBy("duration_ms")
    placed = counts.withColumn("upto", F.sum("c").over(order)).withColumn("all", F.sum("c").over(Window.partitionBy("name")))
    middle = placed.filter(F.col("upto") > F.floor(F.col("all") / 2)).groupBy("name").agg(F.min("duration_ms").alias("p50"))
    return rows.groupBy("name", "kind").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms")).join(middle, "name")


@query("arm_rates", f"""WITH {T.OUTCOMES_SQL}, c AS (SELECT arm, category, count(*)::DOUBLE AS n, count_if(solved)::DOUBLE AS k FROM outcomes GROUP BY ALL), p AS (SELECT *, k / n AS r FROM c)
  SELECT arm, category, n::BIGINT AS runs, k::BIGINT AS solved, round(r, 8) AS rate,
  round(greatest(0, least(1, (r + 3.8416 / (2 * n) - 1.96 * sqrt(r * (1 - r) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n))), 8) AS low,
  round(greatest(0, least(1, (r + 3.8416 / (2 * n) + 1.96 * sqrt(r * (1 - r) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n))), 8) AS high FROM p""")
def arm_rates(spark, sf_dir):
    return evalstats.rates(T.outcomes(spark, sf_dir), "arm", "category")


@query("confusion", f"WITH {T.OUTCOMES_SQL} SELECT arm, count_if(claimed AND solved)::BIGINT AS tp, count_if(claimed AND NOT solved)::BIGINT AS fp, count_if(NOT claimed AND NOT solved)::BIGINT AS tn, count_if(NOT claimed AND solved)::BIGINT AS fn FROM outcomes GROUP BY arm")
def confusion(spark, sf_dir):
    return evalstats.confusion(T.outcomes(spark, sf_dir), "arm")


@query("mcnemar", f"""WITH {T.RUNS_SQL}, g AS (SELECT task_id, repetition, arg_max(solved, doc_id) FILTER (arm = 'en') AS a, arg_max(solved, doc_id) FILTER (arm = 'de') AS b FROM runs WHERE error IS NULL GROUP BY ALL),
  n AS (SELECT count_if(b AND NOT a)::BIGINT AS won, count_if(a AND NOT b)::BIGINT AS lost FROM g WHERE a IS NOT NULL AND b IS NOT NULL)
  SELECT won, lost, round(CASE WHEN won + lost = 0 THEN 1.0 ELSE least(1.0, (SELECT 2 * sum(exp(lgamma(won + lost + 1.0) - lgamma(i + 1.0) - lgamma(won + lost - i + 1.0) - (won + lost) * ln(2.0))) FROM range(0, least(won, lost) + 1) t(i))) END, 8) AS p FROM n""")
def mcnemar(spark, sf_dir):
    """Pairs of runs that did not err, the last of each arm."""
    return evalstats.mcnemar(results.pairs(T.runs(spark, sf_dir), "en", "de", F.col("solved"), "doc_id"))


def _wilson_sql(name: str, k: str, n: str) -> str:
    r, m = f"({k}::DOUBLE / {n})", f"{n}::DOUBLE"
    reach = f"1.96 * sqrt({r} * (1 - {r}) / {m} + 3.8416 / (4 * {m} * {m}))"
    low, high = (f"CASE WHEN {n} > 0 THEN round(greatest(0.0, least(1.0, ({r} + 3.8416 / (2 * {m}) {sign} {reach}) / (1 + 3.8416 / {m}))), 8) ELSE 0.0 END AS {name}_{end}" for sign, end in (("-", "low"), ("+", "high")))
    return f"{k} AS {name}, CASE WHEN {n} > 0 THEN round({r}, 8) ELSE 0.0 END AS {name}_rate, {low}, {high}"


@query("acceptance_rates", f"""WITH {T.RUNS_SQL}, n AS (SELECT arm, count_if(claimed AND solved)::BIGINT AS tp, count_if(claimed AND NOT solved)::BIGINT AS fp, count_if(NOT claimed AND NOT solved)::BIGINT AS tn, count_if(NOT claimed AND solved)::BIGINT AS fn
    FROM runs WHERE CASE WHEN status IS NULL THEN error IS NULL ELSE status IN ('completed', 'task_failed') END GROUP BY arm)
  SELECT arm, tp, fp, tn, fn, {_wilson_sql('accepted_wrongly', 'fp', '(tp + fp)')}, {_wilson_sql('wrong_share', 'fp', '(tp + fp + tn + fn)')}, {_wilson_sql('rejected_wrongly', 'fn', '(tn + fn)')} FROM n""")
def acceptance_rates(spark, sf_dir):
    """A10: false acceptance among claims and among all, and false rejection, over runs that are evidence."""
    return results.acceptance_rates(T.runs(spark, sf_dir))


@query("status_counts", f"WITH {T.RUNS_SQL} SELECT arm, CASE WHEN status IS NOT NULL THEN status WHEN error IS NOT NULL THEN 'environment_failed' WHEN solved THEN 'completed' ELSE 'task_failed' END AS status, count(*) AS n FROM runs GROUP BY ALL")
def status_counts(spark, sf_dir):
    """Runs by their status, worked out where they have none."""
    return results.status_counts(T.runs(spark, sf_dir))


@query("result_files", f"""WITH {T.RUNS_SQL}, n AS (SELECT arm, category, count_if(error IS NULL)::BIGINT AS runs, count_if(error IS NOT NULL)::BIGINT AS errored, coalesce(sum(tokens_used) FILTER (error IS NULL), 0)::BIGINT AS tokens, count_if(error IS NULL AND solved)::BIGINT AS s,
    count_if(error IS NULL AND claimed AND NOT solved)::BIGINT AS f, count_if(error IS NULL AND NOT claimed AND solved)::BIGINT AS m, count_if(error IS NULL AND tampered)::BIGINT AS t FROM runs WHERE doc_id % 8 < 7 GROUP BY GROUPING SETS ((arm), (arm, category)))
  SELECT arm, category, runs, errored, tokens, {', '.join(_wilson_sql(name, k, 'runs') for name, k in (('solved', 's'), ('false_accept', 'f'), ('missed', 'm'), ('tampered', 't')))} FROM n""")
def result_files(spark, sf_dir):
    """Runs written to result files and read again; an eighth is of a newer version and rejected, and all rates are derived anew."""
    runs, folder = T.runs(spark, sf_dir), Scratch(spark, "results").path
    results.save_results(runs.filter("doc_id % 8 < 7"), f"{folder}/known")
    newer = runs.filter("doc_id % 8 = 7").select(F.lit(results.VERSION + 1).alias("benchmark_schema_version"), F.array(F.struct("run_id", "arm", "solved")).alias("outcomes"), F.lit(1.0).alias("solved_rate"))
    newer.write.json(f"{folder}/newer")
    return results.arm_summary(results.load_results(spark, [f"{folder}/known", f"{folder}/newer"], lines=True)[0])


@query("stability", f"WITH {T.OUTCOMES_SQL} SELECT arm, count(*) AS cells, count_if(v > 1)::BIGINT AS unstable, max(passes)::BIGINT AS passes FROM (SELECT arm, task_id, count(DISTINCT solved) AS v, max(repetition) AS passes FROM outcomes GROUP BY ALL) GROUP BY arm")
def stability(spark, sf_dir):
    cells = T.outcomes(spark, sf_dir).groupBy("arm", "task_id").agg(F.countDistinct("solved").alias("v"), F.max("repetition").alias("passes"))
    return cells.groupBy("arm").agg(F.count("*").alias("cells"), F.count_if(F.col("v") > 1).alias("unstable"), F.max("passes").alias("passes"))


@query("uncertain_ops", "SELECT conv_id AS task_id, turn AS seq FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k = 1 AND role <> 'assistant'")
def uncertain_ops(spark, sf_dir):
    """Each task's last operation, where nothing answers it."""
    last = T.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max(F.struct("turn", "role")).alias("m"))
    return last.filter(F.col("m.role") != "assistant").select(F.col("conv_id").alias("task_id"), F.col("m.turn").alias("seq"))


@query("vector_top1", """WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, list_sum(list_transform(list_zip(e.embedding, q), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) AS dot FROM embeddings e, q)
  SELECT query_id, vec_id, round(dot, 6) AS dot FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dot DESC, vec_id) AS k FROM s) WHERE k = 1""")
def vector_top1(spark, sf_dir):
    vectors = T.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    queries = vectors.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return retrieval.top_vectors(vectors, queries).withColumn("dot", F.round("dot", 6))


TERMS = ((1, "trash"), (1, "license"), (2, "clown"), (2, "moron"), (2, "the"))


@query("bm25", f"""WITH q(query_id, term) AS (VALUES {', '.join(map(str, TERMS))}), w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
  z AS (SELECT count(*) AS n, avg(len(w)) AS a FROM w), t AS (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM w), tf AS (SELECT term, doc_id, size, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  s AS (SELECT query_id, doc_id, round(sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / a))), 6) AS score FROM tf JOIN df USING (term) JOIN q USING (term), z GROUP BY query_id, doc_id)
  SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS k FROM s) WHERE k <= 20""")
def bm25(spark, sf_dir):
    """Over a stored index of terms, of which the queries' parts are read."""
    queries = spark.createDataFrame(list(TERMS), "query_id int, term string")
    index = postings.Index(spark, Scratch(spark, "postings").path, 32)
    return index.build(T.table(spark, sf_dir, "documents").select("doc_id", "text")).bm25(queries)
