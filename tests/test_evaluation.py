"""Golden values of the evaluation statistics, and cases that the driver's tables do not have."""

import math

import pytest
from pyspark.sql import functions as F

from skeinwork.operators import checks, evalstats, journal
from skeinwork.plans import evaluations

#: task, arm, repetition, claimed, solved (fixed values)
GOLDEN = [
    ("A", "baseline", 1, 1, 0), ("A", "baseline", 2, 1, 0), ("A", "supervised", 1, 1, 1), ("A", "supervised", 2, 1, 1),
    ("B", "baseline", 1, 1, 1), ("B", "baseline", 2, 1, 1), ("B", "supervised", 1, 1, 1), ("B", "supervised", 2, 1, 1),
    ("C", "baseline", 1, 0, 0), ("C", "baseline", 2, 0, 0), ("C", "supervised", 1, 0, 1), ("C", "supervised", 2, 0, 0),
]


@pytest.fixture(scope="module")
def golden(spark):
    rows = spark.createDataFrame(GOLDEN, "task_id string, arm string, repetition int, claimed int, solved int")
    return rows.withColumns({"claimed": F.col("claimed") == 1, "solved": F.col("solved") == 1})


def test_clustered_bootstrap_of_golden_runs(spark, golden):
    pairs = spark.createDataFrame([("baseline", "supervised"), ("baseline", "none")], "baseline string, variant string")
    rows = {r.variant: r for r in evalstats.clustered_bootstrap(golden, pairs, 500).collect()}
    r = rows["supervised"]
    assert (r.delta, r.tasks, r.runs) == (0.5, 3, 12)
    assert 0 <= r.low <= 0.5 <= r.high <= 1
    assert (rows["none"].tasks, rows["none"].delta, rows["none"].verdict) == (0, None, "insufficient_evidence")


def test_clustered_bootstrap_deals_its_draws(spark):
    """Draws are dealt to all tasks, not put into one, and those of every run are counted: bounds as brute force gives them."""
    cells = {("x", "t"): (21, 9), ("y", "t"): (8, 3), ("x", "u"): (7, 7), ("y", "u"): (1, 0), ("y", "only"): (5, 5)}
    rows = spark.createDataFrame([(a, t, j < k) for (a, t), (n, k) in cells.items() for j in range(n)], "arm string, task_id string, solved boolean")
    found = evalstats.clustered_bootstrap(rows, spark.createDataFrame([("x", "y")], "baseline string, variant string"), 60, "(b * 7919 + slot * 104729 + side * 613 + i * 15485863) % 10007 % {n}")
    draw = lambda b, slot, side, i, n: (b * 7919 + slot * 104729 + side * 613 + i * 15485863) % 10007 % n
    rate = lambda arm, task, b, slot, side: sum(draw(b, slot, side, i, cells[arm, task][0]) < cells[arm, task][1] for i in range(cells[arm, task][0])) / cells[arm, task][0]
    values = []
    for b in range(60):
        picks = [(slot, "tu"[draw(b, slot, 0, 0, 2)]) for slot in range(2)]
        values.append(round(sum(rate("y", t, b, slot, 2) - rate("x", t, b, slot, 1) for slot, t in picks) / 2, 8))
    r, values = found.first(), sorted(values)
    assert (r.tasks, r.runs) == (2, 37) and (r.low, r.high) == (values[1], values[58])
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_ladder_deals_its_draws(spark, golden):
    found = evalstats.ladder(spark.createDataFrame([("A", "baseline", True), ("B", "supervised", True)], "letter string, arm string, wired boolean"), golden, 50)
    assert [(r.letter, r.over, r.delta) for r in found.orderBy("letter").collect()] == [("A", None, None), ("B", "baseline", 0.5)]
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_short_draw_is_the_draw(spark):
    """The draw of the queries in two long divisions gives what the SQL's gives in four, also where its parts are large."""
    short = evaluations._short_draw().format(n="n")
    assert short.count("% 2147483647") == 2
    rows = [(b, slot, side, i, n) for b in (0, 1, 2147, 9999) for slot in (0, 19, 10**9) for side in (0, 1, 2) for i in (0, 7, 138, 10**5, 3 * 10**9) for n in (1, 20, 36_913, 2**31 - 1)]
    got = spark.createDataFrame(rows, "b long, slot long, side int, i long, n long").selectExpr(f"{short} AS x", f"{evaluations._draw('n')} AS y").collect()
    want = [(b * 1000003 + slot * 7919 + side * 104729 + i * 15485863 + 12345) * 48271 * 69621 % 2147483647 % n for b, slot, side, i, n in rows]
    assert [r.x for r in got] == [r.y for r in got] == want


def test_sign_test(spark):
    rows = spark.createDataFrame([(12, 0), (5, 5), (0, 0), (1, 0)], "won long, lost long")
    got = [r.p for r in rows.select(evalstats.exact_p(F.col("won"), F.col("lost")).alias("p")).collect()]
    assert math.isclose(got[0], 2 * 0.5**12, rel_tol=1e-9) and got[1:] == [1.0, 1.0, 1.0]


def test_upper_median(spark):
    rows = spark.createDataFrame([("g", v) for v in (1, 2, 3, 4)] + [("one", 7), ("none", None)], "g string, v int")
    got = {r.g: (r.n, r.m, r.beyond) for r in evalstats.order_statistic(rows, ["g"], "v", m="n div 2", beyond="n + 5").collect()}
    assert got == {"g": (4, 3, 4), "one": (1, 7, 7)}


def test_lease_is_judged_in_order(spark):
    asked = [("w", 1, 0, "a", "acquire"), ("w", 2, 10, "b", "acquire"), ("w", 3, 20, "a", "renew"), ("w", 4, 79, "b", "acquire"), ("w", 5, 80, "b", "acquire"), ("w", 6, 81, "a", "release"), ("w", 7, 82, "b", "release"), (None, 1, 0, "a", "acquire")]
    rows = journal.lease_log(spark.createDataFrame(asked, "worktree string, seq int, at int, who string, op string")).orderBy("seq").collect()
    assert [(r.granted, r.holder, r.expires) for r in rows] == [(True, "a", 60), (False, "a", 60), (True, "a", 80), (False, "a", 80), (True, "b", 140), (False, "b", 140), (True, None, None)]


def test_schema_after_three_files(spark):
    """A column that is added stays, one that is dropped goes, a table that is made anew has only what came after."""
    ddl = [("1", 1, "create_table", "users", c, "int", False) for c in ("id", "name", "legacy_field")]
    ddl += [("2", 1, "alter_table", "Users", "email", "text", False), ("2", 2, "alter_table", "users", "legacy_field", None, True)]
    ddl += [("3", 1, "create_table", "s", "old", "int", False), ("3", 2, "drop_table", "s", None, None, False), ("3", 3, "create_table", "s", "id", "int", False)]
    got = checks.schema_after(spark.createDataFrame(ddl, "file string, stmt int, kind string, table string, column string, type string, dropped boolean"))
    assert {(r.table, r.column) for r in got.collect()} == {("users", "id"), ("users", "name"), ("users", "email"), ("s", "id")}
