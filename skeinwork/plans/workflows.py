"""Named queries of contracts, plans, leases, recovery, logs and schemas, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks, failures, journal, paths
from ..sources import tables as T
from .catalog import query

_STATUS = "CASE WHEN value < 30 THEN 'pass' WHEN value < 60 THEN 'skipped' WHEN value < 90 THEN 'error' ELSE 'fail' END"
_CANDIDATE = "CASE event_id % 5 WHEN 0 THEN 'old' WHEN 1 THEN '' ELSE 'now' END"
_SUBJECTS = "c_custkey AS subject, CASE c_custkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'standard' ELSE 'high' END AS level, 'now' AS candidate, c_custkey % 4 = 0 AS effect_expected, c_custkey % 8 = 0 AS effect_made, c_custkey % 7 % 2 AS out_of_scope"
REQUIRED = (("low", "view"), ("standard", "view"), ("standard", "click"), ("high", "view"), ("high", "click"), ("high", "purchase"))


@query("acceptance", f"""WITH s AS (SELECT {_SUBJECTS} FROM customer), req(level, kind) AS (VALUES {', '.join(map(str, REQUIRED))}),
  r AS (SELECT user_id AS subject, event_type AS kind, event_id AS seq, {_STATUS} AS status, {_CANDIDATE} AS on_candidate FROM events),
  w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, kind ORDER BY CASE status WHEN 'pass' THEN 0 WHEN 'skipped' THEN 1 WHEN 'error' THEN 2 ELSE 3 END DESC, seq) AS k FROM r) WHERE k = 1),
  a AS (SELECT s.subject, req.kind || ':' || CASE WHEN w.status IS NULL THEN 'missing' WHEN w.status <> 'pass' THEN w.status WHEN on_candidate NOT IN ('', candidate) THEN 'older' END AS reason FROM s JOIN req ON s.level = req.level LEFT JOIN w ON w.subject = s.subject AND w.kind = req.kind
    UNION ALL SELECT s.subject, w.kind || ':fail' FROM w JOIN s ON s.subject = w.subject WHERE status = 'fail' AND on_candidate IN ('', candidate) AND (level, kind) NOT IN (SELECT level, kind FROM req)
    UNION ALL SELECT subject, 'no_effect' FROM s WHERE effect_expected AND NOT effect_made UNION ALL SELECT subject, 'out_of_scope:' || out_of_scope FROM s WHERE out_of_scope > 0)
  SELECT s.subject, count(reason) = 0 AS accepted, coalesce(string_agg(reason, ',' ORDER BY reason), '') AS reasons FROM s LEFT JOIN a ON a.subject = s.subject GROUP BY s.subject""")
def acceptance(spark, sf_dir):
    """The contract over required kinds, candidates, effect and scope."""
    results = T.table(spark, sf_dir, "events").selectExpr("user_id AS subject", "event_type AS kind", "event_id AS seq", f"{_STATUS} AS status", f"{_CANDIDATE} AS candidate")
    return journal.acceptance(T.table(spark, sf_dir, "customer").selectExpr(*_split(_SUBJECTS)), spark.createDataFrame(list(REQUIRED), "level string, kind string"), results)


def _split(columns: str) -> list[str]:
    """A select list in parts; none of these has a comma within an expression."""
    return columns.split(", ")


@query("presets", f"""WITH f AS (SELECT n_nationkey AS subject, k.name FROM nation, (VALUES ('click'), ('view')) k(name) WHERE n_nationkey % 4 > 0),
  r AS (SELECT user_id % 25 AS subject, event_type AS name, arg_max({_STATUS}, event_id) AS status, arg_max({_CANDIDATE}, event_id) AS candidate FROM events GROUP BY ALL)
  SELECT n_nationkey AS subject, count(f.name) > 0 AND bool_and(coalesce(status = 'pass' AND candidate = 'now', false)) AS passed, count_if(f.name IS NOT NULL AND NOT coalesce(status = 'pass' AND candidate = 'now', false))::BIGINT AS missing
  FROM nation LEFT JOIN f ON f.subject = n_nationkey LEFT JOIN r ON r.subject = n_nationkey AND r.name = f.name GROUP BY n_nationkey""")
def presets(spark, sf_dir):
    """The last result of every frozen preset."""
    nations = T.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("subject"))
    frozen = nations.filter("subject % 4 > 0").select("subject", F.explode(F.array(F.lit("click"), F.lit("view"))).alias("name"))
    results = T.table(spark, sf_dir, "events").selectExpr("user_id % 25 AS subject", "event_type AS name", "event_id AS seq", f"{_STATUS} AS status", f"{_CANDIDATE} AS candidate")
    return journal.presets(nations.withColumn("candidate", F.lit("now")), frozen, results).select(F.col("subject").cast("int").alias("subject"), "passed", "missing")


_STEPS = """l_orderkey AS plan, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS INTEGER) AS step,
  CASE WHEN l_quantity < 3 THEN ' ' ELSE 'step' END AS title, CASE WHEN l_discount < 0.01 THEN 'none' WHEN l_discount > 0.08 THEN 'up' ELSE 'in' END AS reach,
  CASE l_returnflag WHEN 'A' THEN 'low' WHEN 'N' THEN 'standard' ELSE CASE WHEN l_tax > 0.06 THEN 'extreme' ELSE 'high' END END AS verification, CAST(l_partkey % 12 AS INTEGER) AS dep"""


@query("plan_faults", f"""WITH s AS (SELECT {_STEPS} FROM lineitem), n AS (SELECT *, count(*) OVER (PARTITION BY plan) AS n FROM s),
  f AS (SELECT plan, step, CASE WHEN trim(title) = '' THEN 'no_title' WHEN reach = 'none' THEN 'no_scope' WHEN reach = 'up' THEN 'scope_outside' WHEN verification NOT IN ('low', 'standard', 'high') THEN 'no_level' WHEN dep <> 0 AND dep > n THEN 'no_such_step' WHEN dep >= step THEN 'not_before' END AS fault FROM n
    UNION ALL SELECT plan, 0, 'too_many' FROM n WHERE n > 8)
  SELECT plan, step, fault FROM (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY step, fault) AS k FROM f WHERE fault IS NOT NULL) WHERE k = 1""")
def plan_faults(spark, sf_dir):
    """L3: the first fault of each plan."""
    steps = _from(spark, sf_dir, "lineitem", _STEPS)
    scope = F.when(F.col("reach") == "none", F.array().cast("array<string>")).when(F.col("reach") == "up", F.array(F.lit("pkg"), F.lit("../other"))).otherwise(F.array(F.lit("pkg")))
    return journal.plan_faults(steps.select("plan", "step", "title", scope.alias("scope"), "verification", F.when(F.col("dep") == 0, F.array().cast("array<int>")).otherwise(F.array("dep")).alias("depends_on")))


_KIND = "CASE o_orderkey % 6 WHEN 0 THEN 'plan' WHEN 1 THEN 'impact' WHEN 2 THEN 'out_of_scope' WHEN 3 THEN 'apply' WHEN 4 THEN 'budget' ELSE 'other' END"


@query("gates", f"""WITH g AS (SELECT o_orderkey, {_KIND} AS kind, o_custkey % 5 AS breaking, o_custkey % 3 AS outside FROM orders)
  SELECT o_orderkey, kind, CASE WHEN kind = 'impact' AND breaking > 2 THEN 'over_limit:' || breaking WHEN kind = 'out_of_scope' AND outside > 0 THEN 'outside:' || outside WHEN kind = 'apply' THEN 'apply_gated' WHEN kind = 'budget' THEN 'budget' END AS reason FROM g""")
def gates(spark, sf_dir):
    """Why a person is asked, under one policy."""
    policy = {"plan": False, "breaking": False, "out_of_scope": True, "apply": True, "max_breaking": 2}
    rows = T.table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_KIND} AS kind", "o_custkey % 5 AS breaking", "o_custkey % 3 AS outside")
    return rows.select("o_orderkey", "kind", journal.gate(F.col("kind"), F.col("breaking"), F.col("outside"), policy).alias("reason"))


_REQUESTS = "CAST(user_id AS STRING) AS worktree, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq, CAST(event_id % 2 AS STRING) AS who, CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'acquire' WHEN event_type = 'purchase' THEN 'renew' ELSE 'release' END AS op"


@query("lease_log", f"""WITH RECURSIVE q AS (SELECT {_REQUESTS.replace('STRING', 'VARCHAR')}, epoch_us(ts) // 1000000 AS sec FROM events),
  l AS (SELECT worktree, 0::BIGINT AS seq, false AS granted, NULL::VARCHAR AS holder, NULL::BIGINT AS expires FROM q WHERE seq = 1
    UNION ALL SELECT worktree, seq, ok, CASE WHEN NOT ok THEN h WHEN op = 'release' THEN NULL ELSE who END, CASE WHEN NOT ok THEN e WHEN op = 'release' THEN NULL ELSE sec + 40000 END
    FROM (SELECT q.worktree, q.seq, q.who, q.op, q.sec, l.holder AS h, l.expires AS e, CASE WHEN q.op = 'acquire' THEN l.holder IS NULL OR l.holder = q.who OR l.expires <= q.sec ELSE coalesce(l.holder = q.who, false) END AS ok FROM l JOIN q ON q.worktree = l.worktree AND q.seq = l.seq + 1))
  SELECT * FROM l WHERE seq > 0""")
def lease_log(spark, sf_dir):
    """Every request's outcome, each judged by the lease that the ones before it left."""
    return journal.lease_log(_from(spark, sf_dir, "events", f"{_REQUESTS}, unix_timestamp(ts) AS at"), ttl=40_000)


_OPS = """o_custkey AS task, o_orderkey AS seq, CASE o_orderkey % 4 WHEN 0 THEN 'edit' WHEN 1 THEN 'inspect_file' WHEN 2 THEN 'decision' ELSE 'recipe_run' END AS kind, CASE WHEN o_orderstatus <> 'P' THEN 'ok' END AS outcome,
  CASE WHEN o_orderkey % 9 > 0 THEN 'f' || o_orderkey % 3 END AS path, 'h' || o_orderkey % 5 AS before_hash, 'h' || o_orderkey % 7 AS after_hash, CASE WHEN o_orderkey % 3 > 0 THEN 'c' || o_orderkey % 11 END AS candidate_after, 'c' || o_orderkey % 2 AS candidate_before, o_totalprice > 100000 AS accepted"""
_TASKS = "c_custkey AS task, CASE WHEN c_acctbal < 0 THEN 'done' ELSE 'running' END AS state, CASE WHEN c_custkey % 5 > 0 THEN 'c' || c_custkey % 11 END AS current, CASE WHEN c_custkey % 2 = 0 THEN 'p' || c_custkey END AS plan_head"
_FILES = "c_custkey AS task, 'f' || c_custkey % 3 AS path, 'h' || c_custkey % 5 AS hash"
_EVIDENCE = "o_custkey AS task, CASE WHEN o_orderkey % 6 > 0 THEN 'c' || o_orderkey % 11 ELSE '' END AS candidate"
_OPEN_SQL = f"""ops AS (SELECT {_OPS} FROM orders), files AS (SELECT {_FILES} FROM customer),
  opened AS (SELECT o.task, seq, CASE WHEN kind <> 'edit' OR o.path IS NULL THEN 'unknown' WHEN hash IS NULL THEN 'not_applied' WHEN hash = after_hash THEN 'complete' WHEN hash = before_hash THEN 'not_applied' ELSE 'partial' END AS applied
    FROM ops o LEFT JOIN files f ON f.task = o.task AND f.path = o.path WHERE outcome IS NULL)"""


def _from(spark, sf_dir, name, columns):
    """A select list over a table; the table is an argument, so no view is left in the caller's session."""
    return spark.sql(f"SELECT {columns} FROM {{rows}}", rows=T.table(spark, sf_dir, name))


@query("open_operations", f"WITH {_OPEN_SQL} SELECT * FROM opened")
def open_operations(spark, sf_dir):
    """L1: how operations without an outcome stand."""
    return journal.open_operations(_from(spark, sf_dir, "orders", _OPS), _from(spark, sf_dir, "customer", _FILES))


@query("journal_state", f"""WITH {_OPEN_SQL}, t AS (SELECT {_TASKS} FROM customer), ev AS (SELECT {_EVIDENCE} FROM orders),
  d AS (SELECT task, arg_max(candidate_after, seq) FILTER (WHERE outcome IS NOT NULL AND candidate_after <> '') AS last_completed, count_if(outcome IS NULL)::BIGINT AS n_open, count(DISTINCT path) FILTER (WHERE kind = 'inspect_file') AS inspected, string_agg(DISTINCT path, ',' ORDER BY path) FILTER (WHERE kind = 'inspect_file') AS seen, string_agg(DISTINCT path, ',' ORDER BY path) FILTER (WHERE kind = 'edit' AND outcome IS NOT NULL) AS edited,
    count_if(kind = 'edit' AND outcome IS NOT NULL AND path IS NOT NULL)::BIGINT AS edits, count_if(kind = 'decision' AND accepted)::BIGINT AS accepted, count_if(kind = 'decision' AND NOT accepted)::BIGINT AS rejected FROM ops GROUP BY task),
  p AS (SELECT task, min(seq) AS part_seq FROM opened WHERE applied = 'partial' GROUP BY task), s AS (SELECT t.task, count_if(current <> '' AND candidate <> '' AND candidate <> current)::BIGINT AS stale FROM t JOIN ev ON ev.task = t.task GROUP BY t.task),
  a AS (SELECT t.task, last_completed, coalesce(last_completed <> '' AND current <> '' AND last_completed <> current, false) AS drifted, coalesce(n_open, 0) AS open, coalesce(inspected, 0) AS inspected, coalesce(edits, 0) AS edits, coalesce(accepted, 0) AS accepted, coalesce(rejected, 0) AS rejected, coalesce(stale, 0) AS stale, coalesce(seen, '') AS inspected_paths, coalesce(edited, '') AS edited_paths, part_seq, plan_head
    FROM t LEFT JOIN d ON d.task = t.task LEFT JOIN p ON p.task = t.task LEFT JOIN s ON s.task = t.task WHERE state <> 'done')
  SELECT * EXCLUDE (part_seq, plan_head), CASE WHEN part_seq IS NOT NULL THEN 'reconcile:' || part_seq WHEN drifted THEN 'validate' WHEN stale > 0 THEN 'revalidate' WHEN plan_head IS NOT NULL THEN 'step:' || plan_head ELSE 'plan' END AS next_action FROM a""")
def journal_state(spark, sf_dir):
    """Every live task's state and what to do next."""
    part = lambda name, columns: _from(spark, sf_dir, name, columns)
    state = journal.recovered(part("customer", _TASKS), part("orders", _OPS), part("customer", _FILES), part("orders", _EVIDENCE))
    return state.withColumns({c: F.array_join(c, ",") for c in ("inspected_paths", "edited_paths")})


@query("broken_chain", f"""WITH ops AS (SELECT {_OPS} FROM orders) SELECT task, seq FROM (SELECT *, lag(candidate_after) OVER (PARTITION BY task ORDER BY seq) AS was FROM ops WHERE candidate_after IS NOT NULL) WHERE was <> candidate_before""")
def broken_chain(spark, sf_dir):
    """Where a task's candidates do not follow from one another."""
    return journal.broken_chain(_from(spark, sf_dir, "orders", _OPS))


_CALL = "conv_id % 100 AS session, turn AS step, CASE role WHEN 'user' THEN 'click' ELSE 'view' END AS kind, length(text) % 3 AS arguments"
_DONE = "user_id AS session, event_id % 8 AS step, event_type AS kind, event_id % 3 AS arguments, event_id AS seq"


@query("matched_calls", f"""WITH c AS (SELECT conv_id, turn, role, {_CALL} FROM conversations), o AS (SELECT session, step, kind, arguments, max(seq) AS seq FROM (SELECT {_DONE} FROM events) GROUP BY ALL)
  SELECT conv_id, turn, role, seq FROM c LEFT JOIN o USING (session, step, kind, arguments)""")
def matched_calls(spark, sf_dir):
    """Calls with the last operation of the same session, step, kind and arguments."""
    calls = _from(spark, sf_dir, "conversations", f"conv_id, turn, role, {_CALL}")
    return journal.matched_calls(calls, _from(spark, sf_dir, "events", _DONE), ["session", "step", "kind", "arguments"]).select("conv_id", "turn", "role", "seq")


@query("to_analyze", "SELECT sha256('v1' || chr(0) || 'w' || p_size || chr(0) || p_brand || chr(0) || p_name) AS key, p_partkey FROM part WHERE sha256('v1' || chr(0) || 'w' || p_size || chr(0) || p_brand || chr(0) || p_name) NOT IN (SELECT sha256('v1' || chr(0) || 'w' || p_size || chr(0) || p_brand || chr(0) || p_name) FROM part WHERE p_size < 20)")
def to_analyze(spark, sf_dir):
    """I4: work whose key no earlier run has kept."""
    key = journal.memo_key(F.lit("v1"), F.concat(F.lit("w"), "p_size"), F.col("p_brand"), F.col("p_name"))
    work = T.table(spark, sf_dir, "part").select(key.alias("key"), "p_partkey", "p_size")
    return journal.to_analyze(work, work.filter("p_size < 20")).select("key", "p_partkey")


@query("refreshed", "SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 3 > 0 OR c_nationkey % 5 = 0")
def refreshed(spark, sf_dir):
    """Dirty scopes taken from the new rows, others from the old."""
    customers = T.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    dirty = T.table(spark, sf_dir, "nation").filter("n_nationkey % 5 = 0").select(F.col("n_nationkey").alias("c_nationkey"))
    return journal.refreshed(customers.filter("c_custkey % 3 > 0"), customers.withColumn("c_acctbal", F.col("c_acctbal") + 1), dirty, "c_nationkey")


@query("clean_paths", """SELECT p_partkey, 'src/' || p_brand || '/' || p_size AS a, '/' || p_brand AS b, '../' || p_brand AS c, '.' AS d FROM part""")
def clean_paths(spark, sf_dir):
    """F8: four spellings of paths."""
    spelt = [F.concat(F.lit(" ./src//x/../"), "p_brand", F.lit("/./"), "p_size", F.lit("/ ")), F.concat(F.lit("/../"), "p_brand", F.lit("/")), F.concat(F.lit("a/../../"), "p_brand"), F.concat("p_brand", F.lit("/.."))]
    return T.table(spark, sf_dir, "part").select("p_partkey", *[paths.clean_path(s).alias(n) for s, n in zip(spelt, "abcd")])


@query("derived_ids", "SELECT n_nationkey, sha256(unhex('02' || hex('v1') || CASE WHEN strlen(n) < 128 THEN printf('%02x', strlen(n)) ELSE printf('%02x%02x', strlen(n) % 128 + 128, strlen(n) // 128) END || hex(n) || '01' || hex(n_regionkey::VARCHAR))) AS id FROM (SELECT *, repeat(n_name, CAST(n_nationkey * 3 + 1 AS INTEGER)) AS n FROM nation)")
def derived_ids(spark, sf_dir):
    """ids over parts, each after its length."""
    return T.table(spark, sf_dir, "nation").select("n_nationkey", checks.derived_id(F.lit("v1"), F.repeat("n_name", F.col("n_nationkey").cast("int") * 3 + 1), F.col("n_regionkey").cast("string")).alias("id"))


@query("sql_tables", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'SELECT' WHEN 1 THEN 'UPDATE' END AS verb, CASE p_partkey % 3 WHEN 0 THEN 's.t' || p_size || ',u' WHEN 1 THEN 't' || p_size ELSE '' END AS tables FROM part")
def sql_tables(spark, sf_dir):
    """verbs and table names of texts that look like SQL."""
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("-- name: Get :one\n /* a\nb */ select x from s.t"), "p_size", F.lit(" join u on true join u on true"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("update t"), "p_size", F.lit(" set a = 1"))).otherwise(F.concat(F.lit("taken from t"), "p_size"))
    return T.table(spark, sf_dir, "part").select("p_partkey", failures.sql_verb(text).alias("verb"), F.array_join(failures.sql_tables(text), ",").alias("tables"))


def _log(spark, sf_dir):
    """A test log a user: a named failure for an error, a place for a click, a compiler's finding for a view, else other text."""
    from pyspark.sql import Window

    events = T.table(spark, sf_dir, "events")
    text = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("    --- FAIL: Test"), "event_id", F.lit(" (0.01s)")))
        .when(F.col("event_type") == "click", F.concat(F.lit("        f"), F.col("event_id") % 7, F.lit("_test.go:"), "event_id", F.lit(": got 1")))
        .when(F.col("event_type") == "view", F.concat(F.lit("f"), F.col("event_id") % 3, F.lit(".go:"), F.col("event_id") % 4, F.when(F.col("event_id") % 2 == 0, ":9").otherwise(""), F.lit(": no such name"))).otherwise("ok  \tpkg")
    )
    return events.select(F.col("user_id").alias("log"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("line_no"), text.alias("text"))


@query("failed_tests", """WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line_no FROM events), n AS (SELECT *, max(CASE WHEN event_type = 'error' THEN line_no END) OVER (PARTITION BY user_id ORDER BY line_no) AS now FROM l)
  SELECT user_id AS log, 'Test' || max(event_id) FILTER (WHERE event_type = 'error') AS test, 'f' || (arg_min(event_id, line_no) FILTER (WHERE event_type = 'click')) % 7 || '_test.go' AS file, arg_min(event_id, line_no) FILTER (WHERE event_type = 'click') AS line FROM n WHERE now IS NOT NULL GROUP BY user_id, now""")
def failed_tests(spark, sf_dir):
    """Failed tests with the first place named after each."""
    return failures.failed_tests(_log(spark, sf_dir))


@query("diagnostics", """SELECT DISTINCT user_id AS log, 'f' || event_id % 3 || '.go' AS file, event_id % 4 AS line, CASE WHEN event_id % 2 = 0 THEN 9 ELSE 0 END::BIGINT AS col, 'no such name' AS message FROM events WHERE event_type = 'view'
  UNION SELECT user_id, 'f' || event_id % 7 || '_test.go', event_id, 0, 'got 1' FROM events WHERE event_type = 'click'""")
def diagnostics(spark, sf_dir):
    """distinct compiler findings."""
    return failures.diagnostics(_log(spark, sf_dir))


@query("event_statuses", "SELECT user_id AS log, 'pkg/T' || CAST(value AS BIGINT) % 10 AS test, arg_max(CASE event_type WHEN 'click' THEN 'pass' WHEN 'error' THEN 'fail' ELSE 'skip' END, event_id) AS status FROM (SELECT * REPLACE (floor(value) AS value) FROM events) WHERE event_type IN ('click', 'error', 'signup') GROUP BY ALL")
def event_statuses(spark, sf_dir):
    """the last status of each test in JSON lines, among lines that are not JSON or other actions."""
    action = F.expr("CASE event_type WHEN 'click' THEN 'pass' WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'skip' ELSE 'run' END")
    text = F.when(F.col("event_type") == "view", "not json").otherwise(F.to_json(F.struct(action.alias("Action"), F.lit("pkg").alias("Package"), F.concat(F.lit("T"), F.floor("value").cast("long") % 10).alias("Test"))))
    return failures.event_statuses(T.table(spark, sf_dir, "events").select(F.col("user_id").alias("log"), F.col("event_id").alias("line_no"), text.alias("text")))


_DDL = "CAST(o_orderdate AS DATE) AS file, o_orderkey AS stmt, CASE WHEN o_orderkey % 19 = 0 THEN 'drop_table' WHEN o_orderkey % 3 = 0 THEN 'create_table' ELSE 'alter_table' END AS kind, 'T' || o_custkey % 40 AS name, CASE WHEN o_orderkey % 19 > 0 THEN 'Col' || o_orderkey % 6 END AS col, o_orderpriority AS type, o_orderkey % 4 = 1 AND o_orderkey % 3 > 0 AS dropped"


@query("schema_after", f"""WITH d AS (SELECT {_DDL} FROM orders), c AS (SELECT *, row_number() OVER (PARTITION BY name, col ORDER BY file DESC, stmt DESC) AS k FROM d WHERE col IS NOT NULL), g AS (SELECT name, max((file, stmt)) AS gone FROM d WHERE kind = 'drop_table' GROUP BY name)
  SELECT lower(c.name) AS "table", lower(col) AS "column", type, file FROM c LEFT JOIN g ON g.name = c.name WHERE k = 1 AND NOT dropped AND (gone IS NULL OR (file, stmt) > gone)""")
def schema_after(spark, sf_dir):
    """Columns as a run of DDL statements leaves them."""
    return checks.schema_after(_from(spark, sf_dir, "orders", _DDL).withColumnsRenamed({"name": "table", "col": "column"}))


@query("changed_signatures", """WITH o AS (SELECT o_orderkey AS name, o_orderpriority AS s FROM orders WHERE o_orderkey % 3 > 0), n AS (SELECT o_orderkey AS name, CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE o_orderpriority END AS s FROM orders WHERE o_orderkey % 5 > 0)
  SELECT o.name, 'left' AS mode FROM o LEFT JOIN n ON n.name = o.name WHERE n.s IS NULL OR n.s <> o.s UNION ALL SELECT coalesce(o.name, n.name), 'both' FROM o FULL JOIN n ON n.name = o.name WHERE n.s IS NULL OR o.s IS NULL OR n.s <> o.s""")
def changed_signatures(spark, sf_dir):
    """Changed and removed signatures, and with new ones."""
    orders = T.table(spark, sf_dir, "orders")
    old = orders.filter("o_orderkey % 3 > 0").selectExpr("o_orderkey AS name", "o_orderpriority AS signature")
    new = orders.filter("o_orderkey % 5 > 0").selectExpr("o_orderkey AS name", "CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE o_orderpriority END AS signature")
    return checks.changed_signatures(old, new).withColumn("mode", F.lit("left")).union(checks.changed_signatures(old, new, True).withColumn("mode", F.lit("both")))
