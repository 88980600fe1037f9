"""Named queries of journals, policies, failures and sinks, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, journal, paths
from ..operators import failures as failures_of
from ..sources import tables as T
from .catalog import query


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("task"), F.col("turn").alias("seq"), "role", F.coalesce("text", F.lit("")).alias("text"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "lineitem")


@query("last_checkpoint", "SELECT conv_id AS task, max(turn) AS seq, sha256(arg_max(coalesce(text, ''), turn)) AS state FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def last_checkpoint(spark, sf_dir):
    """The newest row of each task."""
    return journal.latest(_turns(spark, sf_dir).filter("role = 'assistant'").drop("role"), ["task"], ["seq"]).select("task", "seq", F.sha2("text", 256).alias("state"))


@query("numbered_steps", """WITH b AS (SELECT user_id, count(*) AS seq FROM events WHERE event_type = 'error' GROUP BY user_id)
  SELECT e.user_id, event_id, row_number() OVER (PARTITION BY e.user_id ORDER BY ts, event_id) + coalesce(b.seq, 0) AS seq FROM events e LEFT JOIN b ON e.user_id = b.user_id WHERE event_type = 'click'""")
def numbered_steps(spark, sf_dir):
    """Sequence numbers that go on from what a task has."""
    events = T.table(spark, sf_dir, "events")
    before = events.filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("seq"))
    return journal.numbered(events.filter("event_type = 'click'").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"], before).select("user_id", "event_id", "seq")


@query("last_completed", """SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS candidate FROM events""")
def last_completed(spark, sf_dir):
    """The last candidate that was completed before each step."""
    events = T.table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return journal.carried(events, "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("event_id")), "candidate").select("user_id", "event_id", "candidate")


@query("ladder_chain", """WITH x AS (SELECT o_custkey AS chain, o_orderkey AS rung, o_orderstatus = 'F' AS wired, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'F' ORDER BY o_orderkey) AS g FROM orders)
  SELECT chain, max(n)::BIGINT AS longest FROM (SELECT chain, count_if(wired) AS n FROM x GROUP BY chain, wired, g) GROUP BY chain""")
def ladder_chain(spark, sf_dir):
    """The longest run of consecutive rungs that are wired."""
    return journal.longest_run(T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chain"), "o_orderkey", "o_orderstatus"), "chain", "o_orderkey", F.col("o_orderstatus") == "F")


@query("layer_pairs", "SELECT DISTINCT conv_id AS task, a, b FROM (SELECT conv_id, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS a, role AS b FROM conversations) WHERE a <> b")
def layer_pairs(spark, sf_dir):
    """Edges between neighbours in order."""
    return journal.consecutive_pairs(_turns(spark, sf_dir), "task", "seq", "role")


_RESULTS = "results AS (SELECT user_id AS subject, event_type AS kind, CASE WHEN value < 20 THEN 'pass' WHEN value < 40 THEN 'skipped' WHEN value < 60 THEN 'error' ELSE 'fail' END AS status FROM events)"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    status = F.when(v < 20, "pass").when(v < 40, "skipped").when(v < 60, "error").otherwise("fail")
    return T.table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), F.col("event_type").alias("kind"), status.alias("status"))


@query("required_kinds", f"""WITH {_RESULTS}, k(kind) AS (VALUES ('click'), ('purchase'), ('review')), w AS (SELECT subject, kind, max(list_position(['pass', 'skipped', 'error', 'fail'], status)) AS r FROM results GROUP BY ALL)
  SELECT s.subject, k.kind, coalesce(['pass', 'skipped', 'error', 'fail'][r], 'missing') AS status FROM (SELECT DISTINCT subject FROM results) s CROSS JOIN k LEFT JOIN w ON s.subject = w.subject AND k.kind = w.kind""")
def required_kinds(spark, sf_dir):
    """The worst result of each required kind."""
    rows = _results(spark, sf_dir)
    return journal.required_results(rows, spark.createDataFrame([("click",), ("purchase",), ("review",)], "kind string"), rows)


@query("passing_kinds", f"WITH {_RESULTS} SELECT subject, count(DISTINCT CASE WHEN status = 'pass' THEN kind END) AS passing FROM results GROUP BY subject")
def passing_kinds(spark, sf_dir):
    return journal.passing_kinds(_results(spark, sf_dir))


_TESTS = "tests AS (SELECT l_suppkey AS recipe, l_partkey AS test, bool_and(l_discount < 0.09) AS passed FROM lineitem WHERE l_linestatus = '{}' GROUP BY ALL)"


def _tests(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    rows = _items(spark, sf_dir).filter(F.col("l_linestatus") == status)
    return rows.groupBy(F.col("l_suppkey").alias("recipe"), F.col("l_partkey").alias("test")).agg(F.bool_and(F.col("l_discount") < 0.09).alias("passed"))


@query("regressions", f"""WITH a AS (WITH {_TESTS.format('O')} SELECT * FROM tests), b AS (WITH {_TESTS.format('F')} SELECT * FROM tests), w AS (SELECT recipe FROM b GROUP BY recipe HAVING count_if(NOT passed) < 40)
  SELECT recipe, test FROM a WHERE NOT passed AND (recipe IN (SELECT recipe FROM w) OR (recipe, test) IN (SELECT recipe, test FROM b WHERE passed))""")
def regressions(spark, sf_dir):
    """Against tests that pass in the baseline, and recipes that pass there as a whole, here with under 40 failures."""
    baseline = _tests(spark, sf_dir, "F")
    whole = baseline.groupBy("recipe").agg(F.lit(None).cast("long").alias("test"), (F.count_if(~F.col("passed")) < 40).alias("passed"))
    return failures_of.regressions(_tests(spark, sf_dir, "O"), baseline.unionByName(whole))


@query("flaky_runs", """WITH f AS (SELECT l_suppkey AS run, l_partkey AS test FROM lineitem WHERE l_linestatus = 'O' AND l_discount >= 0.09), c AS (SELECT l_suppkey AS run FROM lineitem WHERE l_linestatus = 'F' AND l_shipdate < TIMESTAMP '1992-06-01' GROUP BY 1 HAVING count_if(l_discount >= 0.09) = 0)
  SELECT run, test, CASE WHEN run IN (SELECT run FROM c) THEN 'FLAKY' ELSE 'FAILED' END AS class FROM f""")
def flaky_runs(spark, sf_dir):
    """A27."""
    rows = _items(spark, sf_dir).select(F.col("l_suppkey").alias("run"), F.col("l_partkey").alias("test"), (F.col("l_discount") < 0.09).alias("passed"), "l_linestatus", "l_shipdate")
    return journal.flaky(rows.filter("l_linestatus = 'O'").select("run", "test", "passed"), rows.filter("l_linestatus = 'F' AND l_shipdate < '1992-06-01'").select("run", "test", "passed"))


@query("top_repeats", """WITH c AS (SELECT user_id AS task, event_type AS call, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1)
  SELECT task, call, n, others FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY n DESC, call) AS k, greatest(count(*) OVER (PARTITION BY task) - 3, 0) AS others FROM c) WHERE k <= 3""")
def top_repeats(spark, sf_dir):
    """A20."""
    return journal.top_repeats(T.table(spark, sf_dir, "events").select(F.col("user_id").alias("task"), F.col("event_type").alias("call")))


@query("needle_cap", """WITH p AS (SELECT p_brand AS model, p_size AS size, bool_and(p_partkey % 17 <> 0) AS ok FROM part WHERE p_partkey % 5 <> 0 GROUP BY ALL), f AS (SELECT model, min(CASE WHEN NOT ok THEN size END) AS bad FROM p GROUP BY model)
  SELECT p.model, max(CASE WHEN bad IS NULL OR size < bad THEN size END) AS size FROM p JOIN f ON p.model = f.model GROUP BY p.model""")
def needle_cap(spark, sf_dir):
    """A25."""
    found = F.when(F.col("p_partkey") % 5 != 0, F.col("p_partkey") % 17 != 0)
    return journal.needle_cap(T.table(spark, sf_dir, "part").select(F.col("p_brand").alias("model"), F.col("p_size").alias("size"), found.alias("found")))


@query("candidate_rank", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY out, passing DESC, diff, candidate) AS place FROM (SELECT p_brand AS task, p_partkey AS candidate, p_partkey % 3 AS out, p_size % 4 AS passing, p_partkey % 101 AS diff FROM part WHERE p_size > 5)),
  t AS (SELECT task, count(*) = 2 AND min(out) = max(out) AND min(passing) = max(passing) AS tie FROM r WHERE place <= 2 GROUP BY task) SELECT task, candidate, place, tie FROM r JOIN t USING (task)""")
def candidate_rank(spark, sf_dir):
    """O6."""
    k = F.col("p_partkey")
    return journal.ranked_candidates(T.table(spark, sf_dir, "part").select(F.col("p_brand").alias("task"), k.alias("candidate"), (F.col("p_size") > 5).alias("acceptable"), (k % 3).alias("out_of_scope"), (F.col("p_size") % 4).alias("passing"), (k % 101).alias("diff_bytes")))


_OLD_NEW = "old AS (SELECT s_suppkey AS k, s_nationkey AS v FROM supplier), new AS (SELECT c_custkey AS k, c_nationkey AS v FROM customer WHERE c_custkey % 2 = 0 AND c_custkey < 200)"


def _old_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    customers = T.table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0 AND c_custkey < 200")
    return T.table(spark, sf_dir, "supplier").selectExpr("s_suppkey k", "s_nationkey v"), customers.selectExpr("c_custkey k", "c_nationkey v")


@query("upsert_latest", f"WITH {_OLD_NEW} SELECT * FROM new UNION ALL SELECT * FROM old WHERE k NOT IN (SELECT k FROM new)")
def upsert_latest(spark, sf_dir):
    """S11."""
    return journal.upsert(*_old_new(spark, sf_dir), ["k"])


@query("insert_missing", f"WITH {_OLD_NEW} SELECT * FROM old UNION ALL SELECT * FROM new WHERE k NOT IN (SELECT k FROM old)")
def insert_missing(spark, sf_dir):
    """S12."""
    return journal.insert_missing(*_old_new(spark, sf_dir), ["k"])


@query("replace_partition", f"WITH {_OLD_NEW}, o AS (SELECT k % 7 AS w, k, v FROM old), n AS (SELECT k % 7 AS w, k, v FROM new WHERE k % 7 < 3) SELECT * FROM n UNION ALL SELECT * FROM o WHERE w NOT IN (SELECT w FROM n)")
def replace_partition(spark, sf_dir):
    """A workspace's rows go, its new ones come."""
    old, new = _old_new(spark, sf_dir)
    return journal.replace_keys(old.selectExpr("k % 7 w", "k", "v"), new.filter("k % 7 < 3").selectExpr("k % 7 w", "k", "v"), ["w"])


_VARINT = "CASE WHEN {0} < 128 THEN printf('%02x', {0}) ELSE printf('%02x%02x', {0} % 128 + 128, {0} // 128) END"


@query("manifest", f"""WITH f AS (SELECT source AS tree, repeat('dir/', CAST(doc_id % 60 AS INTEGER)) || doc_id AS path, md5(coalesce(text, '')) AS hash FROM documents)
  SELECT tree, sha256(unhex(string_agg({_VARINT.format('strlen(path)')} || hex(path) || {_VARINT.format('strlen(hash)')} || hex(hash), '' ORDER BY path))) AS digest FROM f GROUP BY tree""")
def manifest(spark, sf_dir):
    """One digest a source, of paths of up to some 240 bytes and their hashes."""
    docs = T.table(spark, sf_dir, "documents")
    path = F.concat(F.repeat(F.lit("dir/"), (F.col("doc_id") % 60).cast("int")), "doc_id")
    return journal.manifest(docs.select(F.col("source").alias("tree"), path.alias("path"), F.md5(F.coalesce("text", F.lit(""))).alias("hash")))


@query("status_hist", f"WITH {T.OUTCOMES_SQL} SELECT arm, CASE WHEN solved THEN 'completed' WHEN claimed THEN 'task_failed' ELSE 'environment_failed' END AS status, count(*) AS n FROM outcomes GROUP BY ALL")
def status_hist(spark, sf_dir):
    """Runs by classified status."""
    status = F.when(F.col("solved"), "completed").when(F.col("claimed"), "task_failed").otherwise("environment_failed")
    return T.outcomes(spark, sf_dir).groupBy("arm", status.alias("status")).agg(F.count("*").alias("n"))


@query("minimum_repeats", f"WITH {T.OUTCOMES_SQL} SELECT min(n) AS repeats, count(DISTINCT arm) AS arms FROM (SELECT arm, task_id, count_if(solved OR claimed) AS n FROM outcomes GROUP BY ALL)")
def minimum_repeats(spark, sf_dir):
    """The fewest evidence runs of any cell."""
    cells = T.outcomes(spark, sf_dir).groupBy("arm", "task_id").agg(F.count_if(F.col("solved") | F.col("claimed")).alias("n"))
    return cells.agg(F.min("n").alias("repeats"), F.countDistinct("arm").alias("arms"))


@query("task_sets", f"WITH {T.OUTCOMES_SQL} SELECT category, arm, count(DISTINCT task_id) AS tasks, avg(CASE WHEN claimed THEN CASE WHEN solved THEN 1.0 ELSE 0.0 END END)::DOUBLE AS mean FROM outcomes GROUP BY GROUPING SETS ((category), (category, arm))")
def task_sets(spark, sf_dir):
    """Task sets by category, and by arm in it; the mean is of claimed runs alone."""
    mean = F.avg(F.when(F.col("claimed"), F.col("solved").cast("double"))).alias("mean")
    rows = T.outcomes(spark, sf_dir).select("category", "arm", "task_id", "claimed", "solved")
    return rows.rollup("category", "arm").agg(F.countDistinct("task_id").alias("tasks"), mean, F.grouping_id().alias("g")).filter("g < 3").drop("g")


_NAMES = ("main.go", ".env.local", "id.PEM", "my-credentials.md", "b.key/c.rs", "node_modules/y.js", ".y.swp", "Makefile", "Dockerfile", "README.md", "a.tsx", "x.tf", "t.proto", "p.toml", "s.bash", "go.mod", "w.swx", ".goutputstream-1", "back.go~", "plain", "h.html", "a.b.Vue", ".#lock", "dist")
_PATH_OF = "concat(CASE WHEN p_size % 9 = 0 THEN '.Agent/secretsx/' ELSE 'src/' END, p_brand, '/', {names}[p_partkey % 24 + {first}])"
_LANG_SQL = """CASE WHEN regexp_matches(low, '[.]go$') THEN 'go' WHEN regexp_matches(low, '[.]tsx?$') THEN 'typescript' WHEN regexp_matches(low, '[.]([mc]js|jsx?)$') THEN 'javascript' WHEN low LIKE '%.vue' THEN 'vue' WHEN low LIKE '%.proto' THEN 'proto'
  WHEN regexp_matches(low, '[.](tf|hcl)$') THEN 'terraform' WHEN low LIKE '%.toml' THEN 'toml' WHEN low LIKE '%.md' THEN 'markdown' WHEN regexp_matches(low, '[.](ba)?sh$') THEN 'shell' WHEN regexp_matches(low, '(^|/)dockerfile$') THEN 'dockerfile' WHEN regexp_matches(low, '(^|/)makefile$') THEN 'make' WHEN regexp_matches(low, '(^|/)go[.](mod|sum)$') THEN 'gomod' ELSE '' END"""


@query("path_checks", f"""WITH p AS (SELECT p_partkey, {_PATH_OF.format(names=list(_NAMES), first=1)} AS path FROM part), l AS (SELECT *, lower(path) AS low FROM p)
  SELECT p_partkey, path, regexp_matches(low, '(^|/)[.]env|[.](pem|key)(/|$)|credentials|^[.]agent/secrets') AS sensitive,
    regexp_matches(path, '(~|[.]swp|[.]swx|[.]tmp)$|/[.]#[^/]*$|[.]goutputstream[^/]*$|(^|/)(node_modules|dist)(/|$)') AS ignored, {_LANG_SQL} AS language FROM l""")
def path_checks(spark, sf_dir):
    """What may be read, what is skipped, and in which language it is."""
    names = "array(" + ", ".join(f"'{n}'" for n in _NAMES) + ")"
    p = F.col("path")
    rows = T.table(spark, sf_dir, "part").select("p_partkey", F.expr(_PATH_OF.format(names=names, first=0)).alias("path"))
    return rows.select("p_partkey", "path", paths.sensitive(p).alias("sensitive"), paths.ignored(p, ("node_modules", "dist")).alias("ignored"), paths.language(p).alias("language"))


_LINE_PATH = "'d' || l_partkey % 10 || '/e' || l_partkey % 7 || '/f' || l_partkey"


def _line_path():
    k = F.col("l_partkey")
    return F.concat(F.lit("d"), k % 10, F.lit("/e"), k % 7, F.lit("/f"), k)


@query("out_of_scope", f"""WITH c AS (SELECT DISTINCT l_suppkey AS task, {_LINE_PATH} AS path FROM lineitem), s(task, form, a) AS (SELECT s_suppkey, 'tree', 'd' || s_suppkey % 10 FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 'tree', 'd3/e' || s_suppkey % 7 FROM supplier WHERE s_suppkey % 4 = 0
    UNION ALL SELECT s_suppkey, 'glob', '^d[45]/e[^/]/f[^/]*' || s_suppkey % 10 || '$' FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, 'bad', '' FROM supplier WHERE s_suppkey % 5 = 0)
  SELECT c.* FROM c WHERE task IN (SELECT task FROM s) AND NOT EXISTS (SELECT 1 FROM s WHERE s.task = c.task AND ((form = 'tree' AND (c.path = s.a OR starts_with(c.path, s.a || '/'))) OR (form = 'glob' AND regexp_matches(c.path, s.a))))""")
def out_of_scope(spark, sf_dir):
    """Folders, trees, globs, and scopes that are refused as they lead out."""
    changed = _items(spark, sf_dir).select(F.col("l_suppkey").alias("task"), _line_path().alias("path"))
    s = T.table(spark, sf_dir, "supplier")
    kinds = ((2, "concat('d', s_suppkey % 10, '/**')"), (4, "concat('./d3//e', s_suppkey % 7)"), (3, "concat('d[45]/e?/f*', s_suppkey % 10)"), (5, "'../d1'"))
    scopes = [s.filter(f"s_suppkey % {n} = 0").selectExpr("s_suppkey task", f"{e} pattern") for n, e in kinds]
    return paths.out_of_scope(changed, scopes[0].union(scopes[1]).union(scopes[2]).union(scopes[3]))


@query("policy_violations", f"""WITH c AS (SELECT DISTINCT {_LINE_PATH} AS path FROM lineitem), r(rule, a) AS (VALUES (1, '^d1(/|$)'), (2, '^d1/e2(/|$)'), (3, '^d9/e6(/|$)'), (4, '^d[^/]*/e[1-2]/f[^/]*7$'), (5, '^d0/e[^0-5]/f[^/]1[^/]*$'))
  SELECT path, rule FROM c JOIN r ON regexp_matches(path, a)""")
def policy_violations(spark, sf_dir):
    """Trees, folders and globs."""
    rules = [(1, "d1/**"), (2, "d1/e2"), (3, "d9/e6/"), (4, "d*/e[1-2]/f*7"), (5, "d0/e[^0-5]/f?1*"), (6, "d[1"), (7, "[2-4]/**")]
    return paths.violations(_items(spark, sf_dir).select(F.concat(F.lit("./"), _line_path()).alias("path")), spark.createDataFrame(rules, "rule int, pattern string"))


@query("tenant_guard", "SELECT event_id, CASE WHEN user_id % 4 <> 1 THEN 'foreign' WHEN event_type = '' OR props IS NULL OR props = '' THEN 'invalid' END AS reason FROM events")
def tenant_guard(spark, sf_dir):
    """P11, P12."""
    rows = T.table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 4).alias("workspace_id"), "event_type", "props")
    return checks.guarded(rows, F.lit(1), ["event_type", "props"]).select("event_id", "reason")


@query("unit_repair", "SELECT event_id, epoch_us(ts) // 1000000 AS s FROM events")
def unit_repair(spark, sf_dir):
    """a third of the stamps in milliseconds, the others in seconds."""
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return T.table(spark, sf_dir, "events").select("event_id", checks.seconds(F.when(F.col("event_id") % 3 == 0, ms).otherwise(F.floor(ms / 1000))).alias("s"))


_FAILS = """f AS (SELECT event_id AS failure_id, event_type AS recipe, user_id AS test, CASE WHEN event_id % 13 = 0 THEN 'error' ELSE 'fail' END AS status, event_id % 11 = 0 AS outside FROM events WHERE event_type <> 'view'),
  p AS (SELECT *, sha256('{"recipe":"' || recipe || '","status":"' || status || '","exit":1,"headline":"bad value at <volatile> after <volatile> on <volatile>","error":"' || CASE WHEN outside THEN 'dial: Network is unreachable' ELSE 'in <volatile>/y' END
    || '","findings":[{"file":"a.go","line":' || test % 2 || ',"col":0,"message":"goes in <volatile>"},{"file":"b.go","line":3,"col":1,"message":"kind ' || test % 3 || '"}],"symbols":["A.f","B"]}') AS print FROM f)"""


@query("failure_class", f"""WITH {_FAILS}, o AS (SELECT DISTINCT event_type AS recipe, user_id AS test FROM events WHERE value < 1), n AS (SELECT print, min(failure_id) AS first FROM p GROUP BY print)
  SELECT failure_id, p.print, CASE WHEN outside OR status = 'error' THEN 'ENVIRONMENTAL' WHEN failure_id > n.first THEN 'SAME' WHEN o.test IS NOT NULL OR p.recipe = 'signup' THEN 'REGRESSION' ELSE 'NEW' END AS class
  FROM p JOIN n ON p.print = n.print LEFT JOIN o ON p.recipe = o.recipe AND p.test = o.test""")
def failure_class(spark, sf_dir):
    """Signup passes as a whole in the baseline, other recipes in some tests."""
    events = T.table(spark, sf_dir, "events")
    i, user = F.col("event_id"), F.col("user_id")
    finding = lambda file, line, col, message: F.struct(file.alias("file"), line.cast("long").alias("line"), F.lit(col).cast("long").alias("col"), message.alias("message"))
    failures = events.filter("event_type <> 'view'").select(
        i.alias("failure_id"), F.col("event_type").alias("recipe"), F.when(i % 13 == 0, "error").otherwise("fail").alias("status"), F.lit(1).alias("exit_code"),
        F.concat(F.lit("bad  value at 0xAf"), i, F.lit(" after 1.5µs on 2024-01-02T03:04:"), i % 60, F.lit(".5+01:00")).alias("headline"),
        F.when(i % 11 == 0, "dial: Network is unreachable").otherwise(F.concat(F.lit("in /tmp/x"), i, F.lit("/y"))).alias("error"),
        F.array(finding(F.lit("b.go"), F.lit(3), 1, F.concat(F.lit("kind "), user % 3)), finding(F.lit("/work/a.go"), user % 2, 0, F.concat(F.lit("goes in goroutine "), i))).alias("findings"),
        F.array(F.lit("B"), F.lit("A.f"), F.lit("B")).alias("symbols"), F.array(user).alias("failed"),
    )
    baseline = events.select(F.col("event_type").alias("recipe"), user.alias("test"), (F.col("value") < 1).alias("passed")).union(spark.sql("SELECT 'signup', CAST(NULL AS BIGINT), true"))
    return failures_of.failure_class(failures, baseline, "/work")


@query("resolved_edges", f"""WITH {T.GRAPH_SQL}, p AS (SELECT 'orders' AS sk, 'orders:' || l_orderkey AS sf, 'supplier' AS dk, 'supplier:' || l_suppkey * 2 AS df, CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS e FROM lineitem)
  SELECT DISTINCT a.node_id AS src, b.node_id AS dst, CASE WHEN e = '' THEN 'unknown' ELSE e END AS evidence FROM p JOIN nodes a ON a.kind = sk AND a.fqn = sf JOIN nodes b ON b.kind = dk AND b.fqn = df""")
def resolved_edges(spark, sf_dir):
    """J5."""
    pending = _items(spark, sf_dir).selectExpr("'orders' src_kind", "concat('orders:', l_orderkey) src_fqn", "'supplier' dst_kind", "concat('supplier:', l_suppkey * 2) dst_fqn", "if(l_returnflag = 'N', '', l_returnflag) evidence")
    return checks.resolved_edges(pending, T.nodes(spark, sf_dir))


@query("inner_edges", f"WITH {T.GRAPH_SQL} SELECT src, dst, kind, rank FROM edges WHERE src % 2 = 0 AND dst % 2 = 0")
def inner_edges(spark, sf_dir):
    """Edges whose both ends are declared."""
    return checks.inner_edges(T.edges(spark, sf_dir), T.nodes(spark, sf_dir).filter("node_id % 2 = 0"))


_NEEDS = (("reader", "A|F"), ("reader", "R|F"), ("writer", "N|O"), ("both", "N|F"), ("both", "N|O"), ("both", "A|F"))


@query("implementers", f"""WITH i(interface, method) AS (VALUES {', '.join(map(str, _NEEDS))}), t AS (SELECT DISTINCT l_partkey AS type, l_returnflag || '|' || l_linestatus AS method FROM lineitem WHERE l_quantity > 25), z AS (SELECT interface, count(*) AS size FROM i GROUP BY interface)
  SELECT i.interface, t.type FROM i JOIN t ON i.method = t.method JOIN z ON z.interface = i.interface GROUP BY i.interface, t.type, z.size HAVING count(*) = z.size""")
def implementers(spark, sf_dir):
    """J10."""
    types = _items(spark, sf_dir).filter("l_quantity > 25").select(F.col("l_partkey").alias("type"), F.concat("l_returnflag", F.lit("|"), "l_linestatus").alias("method"))
    return checks.implementers(spark.createDataFrame(list(_NEEDS), "interface string, method string"), types)


@query("match_query", """SELECT conv_id, turn, array_to_string(list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '[^A-Za-z0-9_./-]+'), lambda t: length(t) >= 2), lambda t: '"' || t || '"'), ' OR ') AS q FROM conversations""")
def match_query(spark, sf_dir):
    """F6."""
    return T.table(spark, sf_dir, "conversations").select("conv_id", "turn", checks.match_query(F.coalesce("text", F.lit(""))).alias("q"))


@query("obligations", f"WITH {T.GRAPH_SQL} SELECT src AS consumer FROM edges WHERE kind = 'uses_type' AND src NOT IN (SELECT 3000000000 + o_custkey FROM orders WHERE o_orderstatus = 'P')")
def obligations(spark, sf_dir):
    """Consumers of a change that no resolution names."""
    done = T.table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select((F.lit(3_000_000_000) + F.col("o_custkey")).alias("consumer"))
    return T.edges(spark, sf_dir).filter("kind = 'uses_type'").select(F.col("src").alias("consumer")).join(done, "consumer", "left_anti")


@query("live_tasks", "SELECT o_orderkey AS task, o_orderstatus AS state FROM orders WHERE o_orderstatus NOT IN ('F', 'P') AND o_orderdate >= TIMESTAMP '1996-01-01'")
def live_tasks(spark, sf_dir):
    """P3, P4."""
    return T.table(spark, sf_dir, "orders").filter(~F.col("o_orderstatus").isin("F", "P") & (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))).select(F.col("o_orderkey").alias("task"), F.col("o_orderstatus").alias("state"))


@query("task_order", "SELECT task, state, place FROM (SELECT o_orderkey AS task, o_orderstatus AS state, row_number() OVER (ORDER BY list_position(['P', 'O', 'F'], o_orderstatus), o_orderdate DESC, o_orderkey) AS place FROM orders) WHERE place <= 100")
def task_order(spark, sf_dir):
    """The first hundred tasks by state, then the newest; a top-k, so no task sorts the table."""
    state = F.array_position(F.array(*map(F.lit, "POF")), F.col("o_orderstatus"))
    first = T.table(spark, sf_dir, "orders").orderBy(state, F.desc("o_orderdate"), "o_orderkey").limit(100)
    return first.selectExpr("o_orderkey task", "o_orderstatus state", "cast(row_number() over (order by array_position(array('P', 'O', 'F'), o_orderstatus), o_orderdate desc, o_orderkey) as bigint) place")
