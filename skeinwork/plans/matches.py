"""Named queries of span, prefix and pattern joins, packing and ordered state, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evalstats, matching, packing, results
from ..sources import tables as T
from .catalog import query

#: Host rules and route patterns that the queries apply (inputs of the queries, in rule order).
HOSTS = ((1, "ththre.example.com", False, []), (2, "*.M.example.com", True, ["model"]), (3, "*.example.com", True, ["model", "tool"]), (4, "*.example.net", True, []), (5, "example.org ", True, []))
ROUTES = ((1, "GET", "/en/{id}"), (2, "", "/{lang}/{id}"), (3, "POST", "/fr/{id}"), (4, "GET", "/de/*"), (5, "", "/*"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


@query("innermost_span", """WITH s AS (SELECT o_orderkey AS span_id, o_custkey AS file_id, o_orderkey % 1000 AS a, o_orderkey % 1000 + o_orderkey % 401 AS b FROM orders),
  p AS (SELECT DISTINCT l_suppkey AS file_id, l_partkey % 1000 AS line FROM lineitem)
  SELECT p.file_id * 1000 + line AS point_id, arg_min(span_id, (b - a) * 1000000000 + span_id) AS span_id FROM p LEFT JOIN s ON p.file_id = s.file_id AND line BETWEEN a AND b GROUP BY 1""")
def innermost_span(spark, sf_dir):
    """Each line that a supplier's items name, with the shortest span of orders about it."""
    key = F.col("o_orderkey") % 1000
    spans = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("span_id"), F.col("o_custkey").alias("file_id"), key.alias("first"), (key + F.col("o_orderkey") % 401).alias("last"))
    points = T.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file_id"), (F.col("l_partkey") % 1000).alias("line")).distinct()
    return matching.innermost_span(points.withColumn("point_id", F.col("file_id") * 1000 + F.col("line")), spans)


def _part_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "part").select("p_partkey", "p_size", F.concat_ws("/", "p_type", "p_brand", "p_name").alias("path"))


_PARTS = "parts AS (SELECT p_partkey, p_size, p_type || '/' || p_brand || '/' || p_name AS path, p_type || '/' || p_brand AS dir, p_type FROM part)"


@query("longest_prefix", f"""WITH {_PARTS}, roots AS (SELECT DISTINCT dir AS root FROM parts WHERE p_partkey % 7 = 0 UNION SELECT DISTINCT p_type FROM parts WHERE p_partkey % 5 = 0)
  SELECT path, arg_max(root, length(root)) AS root FROM (SELECT DISTINCT path FROM parts) LEFT JOIN roots ON path = root OR starts_with(path, root || '/') GROUP BY path""")
def longest_prefix(spark, sf_dir):
    part = T.table(spark, sf_dir, "part")
    roots = part.filter("p_partkey % 7 = 0").select(F.concat_ws("/", "p_type", "p_brand").alias("root")).union(part.filter("p_partkey % 5 = 0").select("p_type"))
    return matching.longest_prefix(_part_paths(spark, sf_dir), roots)


@query("protected_semi", f"WITH {_PARTS} SELECT DISTINCT path FROM parts p WHERE EXISTS (SELECT 1 FROM parts r WHERE r.p_partkey % 11 = 0 AND (p.path = r.dir OR starts_with(p.path, r.dir || '/')))")
def protected_semi(spark, sf_dir):
    guarded = T.table(spark, sf_dir, "part").filter("p_partkey % 11 = 0").select(F.concat_ws("/", "p_type", "p_brand").alias("root"))
    return matching.under(_part_paths(spark, sf_dir), guarded)


_HOST_SQL = "regexp_extract(url, '^https?://([^/]+)', 1)"


@query("host_match", f"""WITH rules(rule_order, pattern, allow, lanes) AS (VALUES {', '.join(str(h) for h in HOSTS)}), h AS (SELECT DISTINCT CASE WHEN page_id % 4 = 0 THEN upper({_HOST_SQL}) || '.' ELSE {_HOST_SQL} END AS host, CASE page_id % 3 WHEN 0 THEN 'model' WHEN 1 THEN 'tool' ELSE 'web' END AS lane FROM pages),
  b AS (SELECT *, rtrim(lower(host), '.') AS bare FROM h), r AS (SELECT *, lower(trim(pattern)) AS p FROM rules)
  SELECT host, lane, min(rule_order)::INTEGER AS rule_order, coalesce(arg_min(allow, rule_order), false) AS allow FROM b LEFT JOIN r ON (bare = p OR (starts_with(p, '*.') AND ends_with(bare, substr(p, 2)))) AND (len(lanes) = 0 OR list_contains(lanes, lane)) GROUP BY host, lane""")
def host_match(spark, sf_dir):
    """Hosts by lane, some in capitals and with a point at the end."""
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    i = F.col("page_id")
    hosts = T.table(spark, sf_dir, "pages").select(F.when(i % 4 == 0, F.concat(F.upper(host), F.lit("."))).otherwise(host).alias("host"), F.when(i % 3 == 0, "model").when(i % 3 == 1, "tool").otherwise("web").alias("lane"))
    return matching.host_rules(hosts, spark.createDataFrame(list(HOSTS), "rule_order int, pattern string, allow boolean, lanes array<string>"))


@query("route_match", """WITH c AS (SELECT page_id AS call_id, CASE WHEN page_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method, regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) AS path FROM pages)
  SELECT call_id, 1 AS route_id FROM c WHERE method = 'GET' AND regexp_full_match(path, '/en/[^/]*')
  UNION ALL SELECT call_id, 2 FROM c WHERE regexp_full_match(path, '/[^/]*/[^/]*') UNION ALL SELECT call_id, 3 FROM c WHERE method = 'POST' AND regexp_full_match(path, '/fr/[^/]*')
  UNION ALL SELECT call_id, 4 FROM c WHERE method = 'GET' AND regexp_full_match(path, '/de/.*') UNION ALL SELECT call_id, 5 FROM c WHERE regexp_full_match(path, '/.*')""")
def route_match(spark, sf_dir):
    calls = T.table(spark, sf_dir, "pages").select(F.col("page_id").alias("call_id"), F.when(F.col("page_id") % 3 == 0, "POST").otherwise("GET").alias("method"), F.regexp_extract("url", r"^https?://[^/]+([^?#]*)", 1).alias("path"))
    return matching.routes(calls, spark.createDataFrame(list(ROUTES), "route_id int, method string, pattern string"))


@query("diff_outer", """SELECT coalesce(c_custkey, s_suppkey) AS path, CASE WHEN c_custkey IS NULL THEN 'created' WHEN s_suppkey IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM customer FULL JOIN supplier ON c_custkey = s_suppkey WHERE c_custkey IS NULL OR s_suppkey IS NULL OR c_nationkey IS DISTINCT FROM s_nationkey OR c_custkey % 3 = 0""")
def diff_outer(spark, sf_dir):
    """Two snapshots, by digest and by mode."""
    before = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), F.col("c_nationkey").alias("digest"), F.lit(0o644).alias("mode"))
    after = T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("path"), F.col("s_nationkey").alias("digest"), F.when(F.col("s_suppkey") % 3 == 0, 0o755).otherwise(0o644).alias("mode"))
    return matching.snapshot_diff(before, after)


@query("commit_semi", """WITH k AS (SELECT DISTINCT l_orderkey AS commit_id, l_partkey AS path FROM lineitem)
  SELECT * FROM k WHERE commit_id IN (SELECT commit_id FROM k GROUP BY commit_id HAVING count(*) <= 3) AND path IN (SELECT p_partkey FROM part WHERE p_size <= 25)""")
def commit_semi(spark, sf_dir):
    touched = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("path"))
    return matching.narrow_commits(touched, T.table(spark, sf_dir, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("path")), 3)


@query("blockers", "SELECT DISTINCT l_orderkey AS task_id, o_orderkey AS blocked_by, o_orderstatus AS state FROM lineitem JOIN orders ON l_partkey = o_orderkey WHERE o_orderstatus <> 'F'")
def blockers(spark, sf_dir):
    """Tasks that a task depends on and that are not accepted."""
    needs = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_partkey").alias("needed")).distinct()
    open_tasks = T.table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'")
    return needs.join(open_tasks, F.col("needed") == F.col("o_orderkey")).select("task_id", F.col("o_orderkey").alias("blocked_by"), F.col("o_orderstatus").alias("state"))


@query("misses_anti", """WITH u AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R')
  SELECT DISTINCT l_suppkey AS recipe, l_partkey AS path FROM lineitem l WHERE l_returnflag = 'A' AND NOT EXISTS (SELECT 1 FROM u WHERE u.l_suppkey = l.l_suppkey AND u.l_partkey = l.l_partkey)""")
def misses_anti(spark, sf_dir):
    """What a recipe's failures name and its packets do not carry."""
    items = T.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("recipe"), F.col("l_partkey").alias("path"), "l_returnflag")
    return items.filter("l_returnflag = 'A'").drop("l_returnflag").distinct().join(items.filter("l_returnflag = 'R'").drop("l_returnflag"), ["recipe", "path"], "left_anti")


@query("line_coverage", """WITH x AS (SELECT o_custkey AS file_id, unnest(range(greatest(1, o_orderkey % 1000 - 3), least(900, o_orderkey % 1000 + o_orderkey % 37 + 3) + 1)) AS line FROM orders),
  y AS (SELECT DISTINCT file_id, line FROM x), z AS (SELECT *, line - row_number() OVER (PARTITION BY file_id ORDER BY line) AS g FROM y) SELECT file_id, min(line)::BIGINT AS first, max(line)::BIGINT AS last FROM z GROUP BY file_id, g""")
def line_coverage(spark, sf_dir):
    key = F.col("o_orderkey") % 1000
    orders = T.table(spark, sf_dir, "orders")
    spans = orders.select(F.col("o_custkey").alias("file_id"), key.alias("first"), (key + F.col("o_orderkey") % 37).alias("last"))
    return matching.covered_lines(spans, orders.select(F.col("o_custkey").alias("file_id"), F.lit(900).cast("long").alias("n_lines")).distinct())


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(packet, seq, cost): turns of conversations, with the token estimate of a slice."""
    return T.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("packet"), F.col("turn").alias("seq"), (F.floor(F.octet_length(F.coalesce("text", F.lit(""))) / 4) + 8).alias("cost"))


_TURNS = "t AS (SELECT conv_id AS packet, turn AS seq, CAST(octet_length(encode(coalesce(text, ''))) // 4 + 8 AS BIGINT) AS cost FROM conversations)"


@query("packet_fill", f"""WITH RECURSIVE {_TURNS}, n AS (SELECT *, row_number() OVER (PARTITION BY packet ORDER BY seq) AS k FROM t),
  f AS (SELECT packet, seq, cost, k, cost <= 400 AS fits, CAST(CASE WHEN cost <= 400 THEN cost ELSE 0 END AS BIGINT) AS used FROM n WHERE k = 1
  UNION ALL SELECT n.packet, n.seq, n.cost, n.k, f.used + n.cost <= 400, CAST(CASE WHEN f.used + n.cost <= 400 THEN f.used + n.cost ELSE f.used END AS BIGINT) FROM f JOIN n ON n.packet = f.packet AND n.k = f.k + 1)
  SELECT packet, seq, cost, used FROM f WHERE fits""")
def packet_fill(spark, sf_dir):
    return packing.greedy_fill(_turns(spark, sf_dir), 400)


@query("notes_cap", f"""WITH RECURSIVE {_TURNS}, n AS (SELECT *, row_number() OVER (PARTITION BY packet ORDER BY seq DESC) AS k FROM t),
  f AS (SELECT packet, seq, cost, k, cost <= 120 AS fits, CAST(CASE WHEN cost <= 120 THEN cost ELSE 0 END AS BIGINT) AS used FROM n WHERE k = 1
  UNION ALL SELECT n.packet, n.seq, n.cost, n.k, f.used + n.cost <= 120, CAST(CASE WHEN f.used + n.cost <= 120 THEN f.used + n.cost ELSE f.used END AS BIGINT) FROM f JOIN n ON n.packet = f.packet AND n.k = f.k + 1)
  SELECT packet, seq, cost FROM f WHERE fits""")
def notes_cap(spark, sf_dir):
    return packing.newest_within(_turns(spark, sf_dir), 120)


@query("chunks_60", """WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), s AS (SELECT *, unnest(range(0, (len(lines) - 1) // 60 + 1)) AS i FROM l)
  SELECT doc_id, (i * 60 + 1)::INTEGER AS first, least(len(lines), i * 60 + 60)::INTEGER AS last, sha256(array_to_string(lines[i * 60 + 1 : i * 60 + 60], chr(10))) AS body_sha256 FROM s""")
def chunks_60(spark, sf_dir):
    return packing.line_chunks(T.table(spark, sf_dir, "documents")).select("doc_id", "first", "last", F.sha2("body", 256).alias("body_sha256"))


_MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"


@query("restart_window", """WITH r AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS restarts FROM events WHERE event_type = 'error')
  SELECT event_id, user_id, restarts, restarts >= 3 AS failed, least(60, power(2, least(restarts, 10) - 1))::BIGINT AS backoff_s FROM r""")
def restart_window(spark, sf_dir):
    """Restarts of a process within the last day, whether they are too many, and the wait before the next one."""
    recent = Window.partitionBy("user_id").orderBy("us").rangeBetween(-86_400_000_000, 0)
    rows = T.table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", "user_id", F.expr(_MICROS).alias("us")).withColumn("restarts", F.count("*").over(recent))
    backoff = F.least(F.lit(60), F.pow(F.lit(2), F.least("restarts", F.lit(10)) - 1)).cast("long")
    return rows.select("event_id", "user_id", "restarts", (F.col("restarts") >= 3).alias("failed"), backoff.alias("backoff_s"))


@query("progress_streaks", """WITH o AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events)
  SELECT user_id, event_type, min(event_id) AS first_event, count(*) AS repeats FROM o GROUP BY user_id, event_type, g HAVING count(*) > 1""")
def progress_streaks(spark, sf_dir):
    """Runs of a user's equal consecutive events."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = T.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    new = rows.withColumn("new", (~F.lag("event_type").over(order).eqNullSafe(F.col("event_type"))).cast("int"))
    runs = new.withColumn("run", F.sum("new").over(order)).groupBy("user_id", "event_type", "run").agg(F.min("event_id").alias("first_event"), F.count("*").alias("repeats"))
    return runs.filter("repeats > 1").drop("run")


@query("lease_state", "SELECT p_brand AS lease, arg_max(p_partkey, p_partkey) AS holder, max(p_partkey) + 60 > 1000 AS live FROM part GROUP BY p_brand")
def lease_state(spark, sf_dir):
    """The last holder of each lease and whether its 60 units still run at 1000."""
    last = T.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("lease")).agg(F.max("p_partkey").alias("holder"))
    return last.withColumn("live", F.col("holder") + 60 > 1000)


_PHASE = ", ".join(f"'{p}'" for p in results.PHASES)
_AFTER = ", ".join(str((a, b)) for a, after in results.TRANSITIONS.items() for b in (a, *after))


@query("phase_violations", f"""WITH e AS (SELECT user_id AS task, event_id AS seq, ([{_PHASE}])[1 + CASE WHEN event_id % 7 < 4 THEN least(7, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)) ELSE event_id % 8 END] AS phase FROM events),
  x AS (SELECT task, seq, lag(phase) OVER (PARTITION BY task ORDER BY seq) AS before, phase FROM e) SELECT * FROM x WHERE (before IS NULL AND phase <> 'INTAKE') OR (before IS NOT NULL AND (before, phase) NOT IN ({_AFTER}))""")
def phase_violations(spark, sf_dir):
    """L2: steps between the eight phases that may not follow."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    at = F.when(F.col("event_id") % 7 < 4, F.least(F.lit(7), k)).otherwise(F.col("event_id") % 8)
    steps = T.table(spark, sf_dir, "events").select(F.col("user_id").alias("task"), F.col("event_id").alias("seq"), F.get(F.array(*map(F.lit, results.PHASES)), at.cast("int")).alias("phase"))
    return results.phase_faults(steps)


def _pick(b: str, j: str, n: str) -> str:
    """A position below n from integers alone, the same in both dialects."""
    return f"(({b} * 1000003 + {j} * 7919 + 12345) % 2147483647 * 48271 % 2147483647 * 69621 % 2147483647) % {n}"


@query("paired_bootstrap", f"""WITH {T.RUNS_SQL}, g AS (SELECT task_id, repetition, arg_max(score, doc_id) FILTER (arm = 'en') AS en, arg_max(score, doc_id) FILTER (arm = 'de') AS de FROM runs WHERE error IS NULL AND score IS NOT NULL GROUP BY ALL),
  p AS (SELECT en - de AS delta, row_number() OVER (ORDER BY task_id, repetition) - 1 AS j, count(*) OVER () AS n FROM g WHERE en IS NOT NULL AND de IS NOT NULL), d AS (SELECT b, {_pick('b', 'p.j', 'n')} AS k FROM p, range(0, 10000) t(b)),
  m AS (SELECT b, avg(delta) AS mean FROM d JOIN p ON k = p.j GROUP BY b), s AS (SELECT list_sort(list(mean)) AS s FROM m)
  SELECT (SELECT count(*) FROM p) AS pairs, round((SELECT avg(delta) FROM p), 8) AS mean, round(s[251], 8) AS low, round(s[9750], 8) AS high FROM s""")
def paired_bootstrap(spark, sf_dir):
    """Graded runs that did not err, by task and repetition, the last of each arm."""
    both = results.pairs(T.runs(spark, sf_dir), "de", "en", F.col("score"), "doc_id")
    return evalstats.paired_bootstrap(both.select("task_id", "repetition", (F.col("variant") - F.col("base")).alias("delta")), _pick("b", "j", "n"))
