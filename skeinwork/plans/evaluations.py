"""Named queries of evaluation statistics, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evalstats, results
from ..sources import tables as T
from .catalog import query

PAIRS = (("en", "de"), ("en", "fr"), ("es", "en"), ("de", "absent"))
_PAIRS = "pairs(baseline, variant) AS (VALUES " + ", ".join(map(str, PAIRS)) + ")"
RUNGS = (("A", "en", True), ("B", "de", True), ("C", "absent", False), ("D", "fr", True), ("E", "es", True), ("F", "absent", True))
_RUNGS = "rungs(letter, arm, wired) AS (VALUES " + ", ".join(map(str, RUNGS)) + ")"


def _draw(n: str, side: str = "side", i: str = "i") -> str:
    """A draw below n from integers alone, the same in both dialects."""
    return f"(b * 1000003 + slot * 7919 + {side} * 104729 + {i} * 15485863 + 12345) % 2147483647 * 48271 % 2147483647 * 69621 % 2147483647 % {n}"


def _short_draw(n: str = "{n}") -> str:
    """_draw() in fewer divisions: both factors are one, by their product modulo 2147483647, and the last is of 32 bits; what i has no part in comes first. n is below 2 ** 31, else it fails."""
    return f"cast((b * 1000003 + slot * 7919 + side * 104729 + 12345 + i * 15485863) % 2147483647 * {48271 * 69621 % 2147483647} % 2147483647 as int) % cast({n} as int)"


# every resample draws a task for each slot and runs within it; a run is a rank, solved below the number of solved ones
_CLUSTERED = f"""runs AS (SELECT arm, task_id, count(*) AS n, count_if(solved)::BIGINT AS k FROM outcomes GROUP BY ALL),
  cells AS (SELECT p.baseline, p.variant, x.n AS nb, x.k AS kb, y.n AS nv, y.k AS kv, row_number() OVER (PARTITION BY p.baseline, p.variant ORDER BY x.task_id) - 1 AS task, count(*) OVER (PARTITION BY p.baseline, p.variant) AS tasks
    FROM pairs p JOIN runs x ON x.arm = p.baseline JOIN runs y ON y.arm = p.variant AND y.task_id = x.task_id),
  drawn AS (SELECT baseline, variant, b, task AS slot, {_draw('tasks', '0', '0').replace('slot', 'task')} AS pick FROM cells, range(0, 10000) t(b)),
  v AS (SELECT d.baseline, d.variant, b, round(avg(len(list_filter(range(0, nv), lambda i: {_draw('nv', '2')} < kv)) / nv - len(list_filter(range(0, nb), lambda i: {_draw('nb', '1')} < kb)) / nb), 8) AS value
    FROM drawn d JOIN cells c ON d.baseline = c.baseline AND d.variant = c.variant AND d.pick = c.task GROUP BY ALL),
  o AS (SELECT *, row_number() OVER (PARTITION BY baseline, variant ORDER BY value) - 1 AS i FROM v),
  bounds AS (SELECT baseline, variant, max(value) FILTER (WHERE i = 250) AS low, max(value) FILTER (WHERE i = 9749) AS high FROM o GROUP BY ALL),
  whole AS (SELECT baseline, variant, count(*) AS tasks, sum(nb + nv)::BIGINT AS runs, round(avg(kv / nv - kb / nb), 8) AS delta FROM cells GROUP BY ALL),
  clustered AS (SELECT p.baseline, p.variant, coalesce(tasks, 0) AS tasks, coalesce(runs, 0) AS runs, delta, low, high,
    CASE WHEN low > 0 THEN 'positive_evidence' WHEN high < 0 THEN 'negative_evidence' WHEN high - low <= 0.2 THEN 'no_material_difference' ELSE 'insufficient_evidence' END AS verdict
    FROM pairs p LEFT JOIN whole w ON p.baseline = w.baseline AND p.variant = w.variant LEFT JOIN bounds b ON p.baseline = b.baseline AND p.variant = b.variant)"""


def _pairs(spark):
    return spark.createDataFrame(list(PAIRS), "baseline string, variant string")


@query("clustered_bootstrap", f"WITH {T.OUTCOMES_SQL}, {_PAIRS}, {_CLUSTERED} SELECT * FROM clustered")
def clustered_bootstrap(spark, sf_dir):
    """X4, A13 (d): intervals of the difference of arms, tasks and runs within them drawn anew."""
    return evalstats.clustered_bootstrap(T.outcomes(spark, sf_dir), _pairs(spark), draw=_short_draw())


@query("comparisons", f"""WITH {T.OUTCOMES_SQL}, {_PAIRS}, r AS (SELECT arm, count(*) AS n, avg(solved::INT) AS r FROM outcomes GROUP BY arm),
  s AS (SELECT p.baseline, p.variant, count(*) AS shared, count_if(y.solved AND NOT x.solved)::BIGINT AS won, count_if(x.solved AND NOT y.solved)::BIGINT AS lost FROM pairs p JOIN outcomes x ON x.arm = p.baseline JOIN outcomes y ON y.arm = p.variant AND y.task_id = x.task_id AND y.repetition = x.repetition GROUP BY ALL),
  c AS (SELECT p.baseline, p.variant, coalesce(b.n, 0) AS baseline_runs, coalesce(v.n, 0) AS variant_runs, round(v.r - b.r, 8) AS delta, coalesce(shared, 0) AS shared, coalesce(won, 0) AS won, coalesce(lost, 0) AS lost
    FROM pairs p LEFT JOIN r b ON b.arm = p.baseline LEFT JOIN r v ON v.arm = p.variant LEFT JOIN s ON s.baseline = p.baseline AND s.variant = p.variant),
  e AS (SELECT *, round(CASE WHEN won + lost = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(won, lost) + 1), lambda i: exp(lgamma(won + lost + 1.0) - lgamma(i + 1.0) - lgamma(won + lost - i + 1.0) - (won + lost) * ln(2.0))))) END, 8) AS p FROM c)
  SELECT *, CASE WHEN baseline_runs = 0 OR variant_runs = 0 THEN 'not_run' WHEN shared = 0 THEN 'no_shared_runs' WHEN p < 0.05 AND delta > 0 THEN 'better' WHEN p < 0.05 AND delta < 0 THEN 'worse' WHEN won + lost = 0 THEN 'agreed' ELSE 'no_difference' END AS verdict FROM e""")
def comparisons(spark, sf_dir):
    """Arms in pairs, with the sign test over the runs they share."""
    return evalstats.comparisons(T.outcomes(spark, sf_dir), _pairs(spark))


@query("ladder_retention", f"""WITH {T.OUTCOMES_SQL}, {_RUNGS}, steps AS (SELECT *, CASE WHEN wired THEN last_value(CASE WHEN wired THEN arm END IGNORE NULLS) OVER (ORDER BY letter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS over_arm FROM rungs),
  pairs AS (SELECT over_arm AS baseline, arm AS variant FROM steps WHERE arm IN (SELECT arm FROM outcomes) AND over_arm IN (SELECT arm FROM outcomes)), {_CLUSTERED}
  SELECT letter, arm, baseline AS over, delta, verdict, CASE verdict WHEN 'positive_evidence' THEN 'keep_enabled' WHEN 'negative_evidence' THEN 'disable_by_default' WHEN 'no_material_difference' THEN 'insufficient_evidence' WHEN 'insufficient_evidence' THEN 'insufficient_evidence' END AS decision
  FROM steps LEFT JOIN clustered c ON arm = c.variant""")
def ladder_retention(spark, sf_dir):
    """Each wired rung against the wired one below it."""
    return evalstats.ladder(spark.createDataFrame(list(RUNGS), "letter string, arm string, wired boolean"), T.outcomes(spark, sf_dir), draw=_short_draw())


_ABLATIONS = (("baseline_comparison", "en", "de"), ("graph_ablation", "en", "absent"), ("context_ablation", "es", "fr"))
_SHARED = ", ".join(f"(SELECT count(*) > 0 FROM runs a JOIN runs b ON a.task_id = b.task_id AND a.repetition = b.repetition WHERE a.arm = '{x}' AND b.arm = '{y}' AND a.error IS NULL AND b.error IS NULL) AS {name}" for name, x, y in _ABLATIONS)


@query("qualification", f"""WITH {T.RUNS_SQL}, t AS (SELECT task_id, min(doc_id) % 2 = 0 AS heldout, bool_and(claimed) AS hidden FROM runs GROUP BY task_id),
  m AS (SELECT arm, min(n) AS least FROM (SELECT arm, task_id, count(*) AS n FROM runs WHERE CASE WHEN status IS NULL THEN error IS NULL ELSE status IN ('completed', 'task_failed') END GROUP BY ALL) GROUP BY arm),
  p AS (SELECT (SELECT avg(solved::INT) FROM runs WHERE repetition % 2 = 0 AND error IS NULL) AS one, (SELECT avg(solved::INT) FROM runs WHERE repetition % 2 = 1 AND error IS NULL) AS two),
  f AS (SELECT (SELECT count_if(heldout) FROM t) AS h, (SELECT count(*) FROM t) AS n, (SELECT count_if(hidden) FROM t) AS hid, coalesce((SELECT min(least) FROM m WHERE least >= 2), 0) AS rep, (SELECT count_if(least >= 2) FROM m) AS fin,
    (SELECT count(*) FROM runs) AS runs, (SELECT count_if(claimed) FROM runs) AS claims, (SELECT count(DISTINCT arm) FROM runs) AS chain, (SELECT count_if(tokens_used = 0) FROM runs) AS missing, coalesce((SELECT abs(one - two) <= 0.05 FROM p), false) AS reproduced, {_SHARED}),
  g(gate, met, observed) AS (SELECT 'heldout_real_tasks', h >= 30, h::VARCHAR FROM f UNION ALL SELECT 'finalist_repeats', rep >= 3 AND fin >= 2, rep || '/' || fin FROM f UNION ALL SELECT 'hidden_verification', n > 0 AND hid = n, hid || '/' || n FROM f
    UNION ALL SELECT 'baseline_comparison', baseline_comparison, baseline_comparison::VARCHAR FROM f UNION ALL SELECT 'component_ladder', chain >= 3, chain::VARCHAR FROM f UNION ALL SELECT 'graph_ablation', graph_ablation, graph_ablation::VARCHAR FROM f UNION ALL SELECT 'context_ablation', context_ablation, context_ablation::VARCHAR FROM f
    UNION ALL SELECT 'false_acceptance_measured', claims > 0, claims::VARCHAR FROM f UNION ALL SELECT 'paired_statistics', runs > 0 AND rep > 0, CASE WHEN runs > 0 AND rep > 0 THEN 'true' ELSE 'false' END FROM f UNION ALL SELECT 'raw_results', runs > 0, runs::VARCHAR FROM f
    UNION ALL SELECT 'environment_metadata', missing = 0, missing::VARCHAR FROM f UNION ALL SELECT 'clean_reproduction', reproduced, reproduced::VARCHAR FROM f)
  SELECT * FROM g UNION ALL SELECT 'all', bool_and(met), string_agg(gate, ',' ORDER BY gate) FILTER (WHERE NOT met) FROM g""")
def qualification(spark, sf_dir):
    """The gates over facts that are aggregated from runs and tasks; an ablation counts where its arms share a run, a reproduction where two passes agree."""
    runs = T.runs(spark, sf_dir)
    tasks = runs.groupBy("task_id").agg((F.min("doc_id") % 2 == 0).alias("heldout"), F.bool_and("claimed").alias("hidden"))
    cells = runs.filter(results.evidence()).groupBy("arm", "task_id").agg(F.count("*").alias("n")).groupBy("arm").agg(F.min("n").alias("least")).filter("least >= 2")
    passes = runs.filter("error is null").agg((F.abs(F.avg(F.expr("if(repetition % 2 = 0, cast(solved as int), null)")) - F.avg(F.expr("if(repetition % 2 = 1, cast(solved as int), null)"))) <= 0.05).alias("same"))
    shared = [results.pairs(runs, x, y, F.col("solved"), "doc_id").agg((F.count("*") > 0).alias("c")).scalar().alias(name) for name, x, y in _ABLATIONS]
    facts = tasks.agg(F.count_if("heldout").alias("heldout_tasks"), F.count("*").alias("tasks"), F.count_if("hidden").alias("hidden_checks")).select(
        "*", cells.agg(F.coalesce(F.min("least"), F.lit(0))).scalar().alias("min_repeats"), cells.agg(F.count("*")).scalar().alias("finalists"),
        runs.agg(F.count("*")).scalar().alias("runs"), runs.agg(F.count_if("claimed")).scalar().alias("claims"), runs.agg(F.countDistinct("arm")).scalar().alias("chain"),
        runs.agg(F.count_if(F.col("tokens_used") == 0)).scalar().alias("missing"), passes.select(F.coalesce("same", F.lit(False))).scalar().alias("reproduced"), *shared,
    )
    return evalstats.qualification(facts)


_FLAWED = "flawed AS (SELECT *, doc_id % 11 = 0 AS errored, doc_id % 13 = 0 AS tampered FROM outcomes)"


@query("caveats", f"""WITH {T.OUTCOMES_SQL}, {_FLAWED}, c AS (SELECT arm, task_id, count(DISTINCT solved) AS v, max(repetition) AS passes FROM flawed GROUP BY ALL), s AS (SELECT count_if(v > 1)::BIGINT AS unstable, max(passes) AS passes FROM c),
  t AS (SELECT DISTINCT task_id, CASE right(task_id, 1) WHEN '0' THEN 'public' WHEN '1' THEN 'unknown' ELSE 'private' END AS leak_risk FROM outcomes)
  SELECT 'set' AS subject, 'unstable' AS caveat, unstable AS n FROM s WHERE passes > 1 AND unstable > 0 UNION ALL SELECT 'set', 'single_pass', 1 FROM s WHERE passes = 1 UNION ALL SELECT 'set', 'small_set', count(*) FROM t HAVING count(*) < 30
  UNION ALL SELECT 'set', 'leak_' || leak_risk, count(*) FROM t WHERE leak_risk <> 'private' GROUP BY leak_risk UNION ALL SELECT arm, 'errored', count(*) FROM flawed WHERE errored GROUP BY arm
  UNION ALL SELECT arm, 'false_claims', count(*) FROM flawed WHERE NOT errored AND claimed AND NOT solved GROUP BY arm UNION ALL SELECT arm, 'tampered', count(*) FROM flawed WHERE NOT errored AND tampered GROUP BY arm""")
def caveats(spark, sf_dir):
    """What weakens the numbers."""
    runs = T.outcomes(spark, sf_dir).selectExpr("*", "doc_id % 11 = 0 AS errored", "doc_id % 13 = 0 AS tampered")
    tasks = runs.select("task_id", F.expr("CASE right(task_id, 1) WHEN '0' THEN 'public' WHEN '1' THEN 'unknown' ELSE 'private' END").alias("leak_risk")).distinct()
    return evalstats.caveats(runs, tasks)


@query("evidence_runs", """SELECT o_orderpriority AS arm, count(*) AS runs, count_if(CASE WHEN status IS NULL THEN err IS NULL ELSE status IN ('completed', 'task_failed') END)::BIGINT AS evidence
  FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'infrastructure_error' END AS status, CASE WHEN o_orderkey % 7 = 0 THEN 'timeout' END AS err FROM orders) GROUP BY o_orderpriority""")
def evidence_runs(spark, sf_dir):
    """Runs that count as evidence."""
    runs = T.table(spark, sf_dir, "orders").selectExpr("o_orderpriority AS arm", "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'infrastructure_error' END AS status", "CASE WHEN o_orderkey % 7 = 0 THEN 'timeout' END AS err")
    return runs.groupBy("arm").agg(F.count("*").alias("runs"), F.count_if(evalstats.evidence_run(F.col("status"), F.col("err"))).alias("evidence"))


@query("order_statistics", """SELECT o_orderpriority, n, max(v) FILTER (WHERE i = n // 2) AS upper_median, max(v) FILTER (WHERE i = floor(0.025 * n)) AS low, max(v) FILTER (WHERE i = floor(0.975 * n) - 1) AS high,
  max(v) FILTER (WHERE i = round(0.95 * (n - 1))) AS p95_rounded, max(v) FILTER (WHERE i = floor(0.95 * (n - 1))) AS p95
  FROM (SELECT o_orderpriority, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) GROUP BY o_orderpriority, n""")
def order_statistics(spark, sf_dir):
    """The upper median, bootstrap bounds, and the two percentile positions."""
    return evalstats.order_statistic(
        T.table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", upper_median="n div 2", low="floor(0.025 * n)", high="floor(0.975 * n) - 1",
        p95_rounded="round(0.95 * (n - 1))", p95="floor(0.95 * (n - 1))",
    )


@query("throughput", f"""WITH {T.TELEMETRY_SQL}, p AS (SELECT kind, duration_ms, row_number() OVER (PARTITION BY kind ORDER BY duration_ms) - 1 AS i, count(*) OVER (PARTITION BY kind) AS c FROM telemetry),
  q AS (SELECT kind, max(duration_ms) FILTER (WHERE i = floor(0.5 * (c - 1))) AS p50, max(duration_ms) FILTER (WHERE i = floor(0.95 * (c - 1))) AS p95 FROM p GROUP BY kind)
  SELECT t.kind, count(*) AS calls, round(avg(1000.0 / (duration_ms + 1)), 6) AS mean_rate, round(100.0 * sum(CASE WHEN name = 'k0' THEN duration_ms ELSE 0 END) / nullif(sum(duration_ms), 0), 6) AS reuse_pct, max(duration_ms) AS peak, any_value(p50) AS p50, any_value(p95) AS p95
  FROM telemetry t JOIN q ON t.kind = q.kind GROUP BY t.kind""")
def throughput(spark, sf_dir):
    """Mean rate, latencies at two positions, share of reused work as a ratio of sums, and the peak."""
    rows = T.telemetry(spark, sf_dir)
    at = evalstats.order_statistic(rows, ["kind"], "duration_ms", p50="floor(0.5 * (n - 1))", p95="floor(0.95 * (n - 1))").drop("n")
    d = F.col("duration_ms")
    reused = F.sum(F.when(F.col("name") == "k0", d).otherwise(0))
    return rows.groupBy("kind").agg(F.count("*").alias("calls"), F.round(F.avg(1000.0 / (d + 1)), 6).alias("mean_rate"), F.round(100.0 * reused / F.nullif(F.sum(d), F.lit(0)), 6).alias("reuse_pct"), F.max(d).alias("peak")).join(at, "kind")


@query("severity_hist", "SELECT event_type AS severity, 'k' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 10) AS linter, count(*) AS n FROM events GROUP BY ALL")
def severity_hist(spark, sf_dir):
    """Findings by severity and linter."""
    return T.telemetry(spark, sf_dir).groupBy(F.col("kind").alias("severity"), F.col("name").alias("linter")).agg(F.count("*").alias("n"))


_OUTPUT = """CASE doc_id % 6 WHEN 0 THEN 'build failed' WHEN 1 THEN concat('--- FAIL: Test', doc_id % 4, ' (0.1s)') WHEN 2 THEN concat('x', chr(10), '    --- FAIL: Test1 (0s)', chr(10), '    --- FAIL: Test1/sub', chr(10), '--- FAIL: TestOther')
  WHEN 3 THEN concat('--- FAIL: Test2', chr(10), '… (output truncated)') WHEN 4 THEN '' END"""


@query("graded", f"""WITH {T.RUNS_SQL}, k AS (SELECT DISTINCT task_id, 1 + length(task_id) % 2 * 3 AS n FROM runs), o AS (SELECT *, {_OUTPUT} AS output FROM runs WHERE error IS NULL AND score IS NULL),
  f AS (SELECT o.*, n + 1 AS total, CASE WHEN solved THEN [] ELSE list_sort(list_distinct(list_filter(regexp_extract_all(output, '--- FAIL: (Test[A-Za-z0-9_]*)', 1), lambda x: list_contains(list_transform(range(0, n + 1), lambda i: 'Test' || i), x)))) END AS failed FROM o JOIN k ON k.task_id = o.task_id WHERE output IS NULL OR NOT contains(output, 'truncated')),
  p AS (SELECT *, CASE WHEN solved THEN total WHEN coalesce(len(failed), 0) = 0 THEN 0 ELSE total - len(failed) END AS passed FROM f)
  SELECT run_id, task_id, arm, total::INTEGER AS total, array_to_string(coalesce(failed, []), ',') AS failed, passed::INTEGER AS passed, round(passed / total, 8) AS score FROM p""")
def graded(spark, sf_dir):
    """Runs not graded before, by the tests that their task's hidden files declare and the failures that their output names."""
    runs = T.runs(spark, sf_dir).withColumn("output", F.expr(_OUTPUT)).withColumn("recorded", F.col("score").isNotNull())
    body = F.concat(F.lit("package x\n// func TestNone() is no declaration\n"), F.array_join(F.transform(F.sequence(F.lit(0), 1 + F.length("task_id") % 2 * 3), lambda i: F.concat(F.lit("func Test"), i.cast("string"), F.lit("(t *testing.T) {}"))), "\n"))
    tests = results.hidden_tests(runs.select("task_id").distinct().withColumn("text", body))
    return results.graded_runs(runs, tests).select("run_id", "task_id", "arm", "total", F.array_join("failed", ",").alias("failed"), "passed", F.round("score", 8).alias("score"))
