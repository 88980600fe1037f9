"""Globs, scopes, failures and result files: cases written down by hand."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from skeinwork.operators import checks, evalstats, failures, journal, paths, results

#: scope, file, whether it covers it (fixed values)
SCOPES = [
    ("src", "src/sub/a.go", True), ("src", "src-other/a.go", False), ("src/*.go", "src/a.go", True), ("src/*.go", "src/sub/a.go", False), ("src/**", "src/sub/a.go", True),
    (".", "src/a.go", True), ("../src", "src/a.go", False), ("/src", "src/a.go", False), ("[", "src/a.go", False), ("", "src/a.go", False),
    ("./src//sub/", "src/sub/a.go", True), ("src/**", "src", True), ("a\\b", "a\\b", False), ("src/../x", "x", False), ("*.go", "a.go", True), ("*.go", "b/a.go", False), ("s?c/[a-c]*", "src/b1", True), ("s?c/[^a-c]*", "src/b1", False),
]


def test_scopes(spark):
    scopes = spark.createDataFrame([(i, s) for i, (s, _, _) in enumerate(SCOPES)], "task long, pattern string")
    changed = spark.createDataFrame([(i, f) for i, (_, f, _) in enumerate(SCOPES)] + [(99, "x")], "task long, path string")
    assert {r.task for r in paths.covered(changed, scopes).collect()} == {i for i, c in enumerate(SCOPES) if c[2]}
    assert {r.task for r in paths.out_of_scope(changed, scopes).collect()} == {i for i, c in enumerate(SCOPES) if not c[2]}  # task 99 has no scope
    bad = {r.pattern: r.reason for r in paths.bad_scopes(scopes).collect()}
    assert bad == {"../src": "outside", "/src": "absolute", "[": "malformed", "": "empty", "a\\b": "backslash", "src/../x": "outside"}


#: glob, text, whether it matches; None where the glob is malformed
GLOBS = [
    ("*", "", True), ("*", "abc", True), ("*", "a/b", False), ("a*b?c", "aXXbYc", True), ("a*b?c", "ab/c", False), ("[a-c]x", "bx", True), ("[^a-c]x", "bx", False), ("[^a-c]x", "zx", True), (r"\*", "*", True), (r"\*", "a", False),
    ("[]a]", "a", None), ("[a", "a", None), ("a\\", "a", None), ("[-a]", "a", None), ("[a-]", "a", None), ("[z-a]", "m", False), (r"[\]]", "]", True), ("é?", "éü", True), ("a.c", "abc", False), ("[^]", "a", None), ("x[a-cx-z]", "xy", True), ("(a|b)+", "a", False), ("", "", True), (r"[\a-\c]", "b", True),
]


def test_globs(spark):
    rows = spark.createDataFrame([(g, t) for g, t, _ in GLOBS], "pattern string, t string").join(paths.globs(spark.createDataFrame([(g,) for g, _, _ in GLOBS], "pattern string")), "pattern")
    got = {(r.pattern, r.t): r.hit for r in rows.select("pattern", "t", F.expr("t rlike regex").alias("hit")).collect()}
    assert got == {(g, t): want for g, t, want in GLOBS}


def test_patterns_meet_paths_by_their_folder(spark):
    heads = {r.pattern: r["head"] for r in paths.globs(spark.createDataFrame([(p,) for p in ("a/b/*.go", "a/b/**", "a/b", "*", "a/b/", "a*/b")], "pattern string")).collect()}
    assert heads == {"a/b/*.go": "a/b", "a/b/**": "a/b", "a/b": "a/b", "*": "", "a/b/": "a/b", "a*/b": ""}
    changed = spark.createDataFrame([("a/b/x.go",)], "path string")
    plan = paths.matches(changed, spark.createDataFrame([("a/*",)], "pattern string"))._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_policy(spark):
    rules = spark.createDataFrame([(1, "policies", "r"), (2, "go.mod", "r"), (3, "a/**", "r"), (4, " ", "r"), (5, "x", ""), (6, "[", "r")], "rule int, pattern string, reason string")
    changed = spark.createDataFrame([("./policies/deep/x.yaml",), ("policies",), ("policies2/x",), ("go.mod",), ("a/b/c",), ("a",), ("ab",)], "path string")
    assert {tuple(r) for r in paths.violations(changed, rules).collect()} == {("policies/deep/x.yaml", 1), ("policies", 1), ("go.mod", 2), ("a/b/c", 3), ("a", 3)}
    assert {tuple(r) for r in paths.bad_rules(rules).collect()} == {(4, "no_path"), (5, "no_reason"), (6, "malformed")}


def test_sensitive_ignored_and_language(spark):
    names = ["a/.env", "a/.ENV.x/y", "k.pem", "k.pem.txt", "x.KEY/y", "my_Credentials", ".agent/secrets", ".agent/secretsx", "b/.agent/secrets", "a/.git/x", "a~", "x.swx", ".goutputstreamQ", "Dockerfile", "a/b.tsx", "go.sum", ".dockerfile", "x.toml", "noext", "a.html"]
    got = spark.createDataFrame([(n,) for n in names], "p string").select("p", paths.sensitive(F.col("p")).alias("s"), paths.ignored(F.col("p")).alias("i"), paths.language(F.col("p")).alias("l")).collect()
    assert [r.p for r in got if r.s] == ["a/.env", "a/.ENV.x/y", "k.pem", "x.KEY/y", "my_Credentials", ".agent/secrets", ".agent/secretsx"]
    assert [r.p for r in got if r.i] == ["a/.git/x", "a~", "x.swx", ".goutputstreamQ"]
    assert [r.l for r in got[-7:]] == ["dockerfile", "typescript", "gomod", "dockerfile", "toml", "", ""]


def test_normalised(spark):
    cases = {
        "took 12ms, 1.5s, 3µs and 4ns": "took <volatile>, <volatile>, <volatile> and <volatile>", "at 0xDEADbeef  in\tgoroutine 12 [running]": "at <volatile> in <volatile> [running]",
        "2024-01-02T03:04:05.6+02:00 and 2024-01-02 03:04:05Z.": "<volatile> and <volatile>", "/tmp/x123/y/z.go:4": "<volatile>/y/z.go:4", "v12ms a12ms 5min 7 m": "v12ms a12ms 5min 7 m", "/work/repo/a.go:1 and /work/repo2/b": "a.go:1 and /work/repo2/b", "  ": "",
    }
    got = {r.t: r.n for r in spark.createDataFrame([(c,) for c in cases], "t string").select("t", failures.normalised(F.col("t"), "/work/repo").alias("n")).collect()}
    assert got == cases


FAILURE = "failure_id long, recipe string, status string, exit_code int, headline string, error string, findings array<struct<file:string,line:long,col:long,message:string>>, symbols array<string>, failed array<string>"


def test_classes_where_several_hold(spark):
    """Regression, then same, then environmental: the last that holds counts."""
    f = [("a.go", 1, 0, "bad")]
    rows = [
        (1, "new", "fail", 1, "h", "", f, [], ["t"]), (2, "new", "fail", 1, "h  ", "", f, [], ["t"]), (3, "known", "fail", 1, "h", "", f, [], ["t"]), (4, "known", "fail", 1, "h", "", f, [], ["t"]),
        (5, "known", "fail", 1, "h", "", [("a.go", 1, 0, "Permission DENIED here")], [], ["t"]), (6, "whole", "fail", 1, "h", "", f, [], []), (7, "known", "error", 1, "h", "", f, [], ["t"]),
        (8, "known", "fail", 1, "Address already in use", "", f, [], ["t"]), (9, "known", "fail", 1, "Address already in use", "", f, [], ["t"]), (10, "known", "fail", 1, "other", "", f, [], ["u"]), (11, "known", "fail", 2, "other", "", f, ["S"], ["u"]),
    ]
    baseline = spark.createDataFrame([("known", "t", True), ("known", "u", False), ("whole", None, True), ("known", None, False)], "recipe string, test string, passed boolean")
    got = {r.failure_id: r["class"] for r in failures.failure_class(spark.createDataFrame(rows, FAILURE), baseline).collect()}
    assert got == {1: "NEW", 2: "SAME", 3: "REGRESSION", 4: "SAME", 5: "ENVIRONMENTAL", 6: "REGRESSION", 7: "ENVIRONMENTAL", 8: "ENVIRONMENTAL", 9: "ENVIRONMENTAL", 10: "NEW", 11: "NEW"}
    now = spark.createDataFrame([("known", "t", False), ("known", "u", False), ("whole", "x", False), ("whole", "y", True)], "recipe string, test string, passed boolean")
    assert {tuple(r) for r in failures.regressions(now, baseline).collect()} == {("known", "t"), ("whole", "x")}


def test_sql_names(spark):
    cases = {
        "select * from a join b.c on x": ("SELECT", ["a", "b.c"]), "-- from z\n/* from y */ insert into t values ('from s', 1)": ("INSERT", ["t"]), "update u set a = 'it''s from v'": ("UPDATE", ["u"]), "fetched from x": (None, []),
        "SELECT": (None, []), "with q as (select 1 from r) delete from r": ("WITH", ["r"]), "selection from a": (None, []), "select 1 from (select 2 from w) k": ("SELECT", ["w"]),
    }
    got = {r.t: (r.v, r.n) for r in spark.createDataFrame([(c,) for c in cases], "t string").select("t", failures.sql_verb(F.col("t")).alias("v"), failures.sql_tables(F.col("t")).alias("n")).collect()}
    assert got == cases


def test_logs(spark):
    lines = ["a.go:3:9: no such name", "  b.go:4: bad: thing", "a.go:3:9: no such name", "c.txt:1: no", "a.go:x: no", "--- FAIL: TestA (0.1s)", "    a_test.go:7: got 1", "    a_test.go:9: got 2", "    --- FAIL: TestA/sub (0s)", "--- PASS: TestB", "WARNING: DATA RACE", "panic: oh", "  panic: again", ".go:1: x"]
    log = spark.createDataFrame([("l", i, t) for i, t in enumerate(lines)], "log string, line_no int, text string")
    assert {tuple(r) for r in failures.diagnostics(log).collect()} == {("l", "a.go", 3, 9, "no such name"), ("l", "b.go", 4, 0, "bad: thing"), ("l", "a_test.go", 7, 0, "got 1"), ("l", "a_test.go", 9, 0, "got 2")}
    assert {tuple(r) for r in failures.failed_tests(log).collect()} == {("l", "TestA", "a_test.go", 7), ("l", "TestA/sub", None, None)}
    assert {tuple(r) for r in failures.crashes(log).collect()} == {("l", "race", 1), ("l", "panic", 2)}
    report = json.dumps({"Issues": [{"FromLinter": "vet", "Severity": "error", "Text": "x", "Pos": {"Filename": "a.go", "Line": 3, "Column": 1}}, {"FromLinter": "style", "Text": "y", "Pos": {"Filename": "b.go"}}]})
    reports = spark.createDataFrame([(1, report), (2, "no json"), (3, "{}")], "report int, text string")
    assert {tuple(r) for r in failures.linter_findings(reports).collect()} == {(1, "vet", "error", "a.go", 3, 1, "x"), (1, "style", "", "b.go", 0, 0, "y")}


def varint(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def test_ids_and_digests_of_long_parts(spark):
    parts = ["", "a", "é" * 64, "x" * 127, "x" * 128, "y" * 20_000, "z" * 3_000_000]
    got = {len(r.p): r.id for r in spark.createDataFrame([(p,) for p in parts], "p string").select("p", checks.derived_id(F.lit("v1"), F.col("p")).alias("id")).collect()}
    assert got == {len(p): hashlib.sha256(b"\x02v1" + varint(len(p.encode())) + p.encode()).hexdigest() for p in parts}
    files = [("t", p, h) for h, p in enumerate(parts)] + [("u", "one", 5), (None, "x", 1)]
    digests = {r.tree: r.digest for r in journal.manifest(spark.createDataFrame([(t, p, str(h) * 40) for t, p, h in files], "tree string, path string, hash string").repartition(3)).collect()}
    want = {t: hashlib.sha256(b"".join(varint(len(x.encode())) + x.encode() for _, p, h in sorted(f for f in files if f[0] == t) for x in (p, str(h) * 40))).hexdigest() for t in "tu"}
    assert digests == want


def test_result_files(spark, tmp_path):
    run = {"run_id": "r1", "task_id": "t", "arm": "a", "solved": True, "claimed": False, "grade": {"total": 3, "failed": ["x"]}}
    for name, text in {"old.json": json.dumps({"outcomes": [run]}, indent=2), "now.json": json.dumps({"benchmark_schema_version": 2, "arms": {"solved": 0.9}, "outcomes": [run | {"run_id": "r2", "error": "lost"}, run | {"run_id": "r3", "status": "invalid"}]}), "new.json": json.dumps({"benchmark_schema_version": 3, "outcomes": [run]}), "bad.json": "{not json"}.items():
        (tmp_path / name).write_text(text)
    runs, rejects = results.load_results(spark, [f"{tmp_path}/{n}.json" for n in ("old", "now", "new", "bad")])
    assert sorted((r.run_id, r.grade.total, r.tampered) for r in runs.collect()) == [("r1", 3, None), ("r2", 3, None), ("r3", 3, None)]
    assert sorted((r.file.rsplit("/", 1)[1], r.reason) for r in rejects.collect()) == [("bad.json", "malformed"), ("new.json", "newer")]
    r = {x.category: x for x in results.arm_summary(runs.withColumn("category", F.lit("c"))).collect()}
    assert (r[None].runs, r[None].errored, r[None].solved, r[None].missed) == (2, 1, 2, 2) and r["c"].runs == 2
    assert [(x.tp, x.fn, x.accepted_wrongly_rate, x.rejected_wrongly_rate) for x in results.acceptance_rates(runs).collect()] == [(0, 1, 0.0, 1.0)]
    assert {(x.status, x.n) for x in results.status_counts(runs).collect()} == {("completed", 1), ("environment_failed", 1), ("invalid", 1)}
    results.save_results(runs, f"{tmp_path}/saved")
    again, none = results.load_results(spark, [f"{tmp_path}/saved"], lines=True)
    assert sorted(map(str, again.drop("file").collect())) == sorted(map(str, runs.drop("file").collect())) and none.count() == 0


def test_pairs_and_bootstrap(spark):
    rows = [("t", 1, "a", 1.0, None, 1), ("t", 1, "a", 0.0, None, 2), ("t", 1, "b", 1.0, None, 3), ("t", 1, "b", 0.5, "lost", 4), ("t", 2, "a", 1.0, None, 5), ("t", 2, "b", None, None, 6), ("u", 1, "a", 1.0, "lost", 7), ("u", 1, "b", 1.0, None, 8)]
    runs = spark.createDataFrame(rows, "task_id string, repetition int, arm string, score double, error string, seq int")
    both = results.pairs(runs, "a", "b", F.col("score"), "seq")
    assert [tuple(r) for r in both.collect()] == [("t", 1, 0.0, 1.0)]
    deltas = lambda rows: spark.createDataFrame(rows, "task_id string, repetition int, delta double")
    pick = "pmod(xxhash64(b, j), n)"
    assert [tuple(r) for r in evalstats.paired_bootstrap(deltas([("t", 1, 0.25)]), pick, 40).collect()] == [(1, 0.25, 0.25, 0.25)]
    assert [tuple(r) for r in evalstats.paired_bootstrap(deltas([]), pick, 40).collect()] == [(0, None, None, None)]
    r = evalstats.paired_bootstrap(deltas([("t", i, i / 10) for i in range(10)]), pick, 400).first()
    assert r.pairs == 10 and r.mean == 0.45 and 0.1 < r.low < 0.45 < r.high < 0.8
    placed = evalstats.positions(deltas([(f"t{i % 7}", i, 0.0) for i in range(500)]).repartition(9), "task_id", "repetition").collect()
    assert [p.j for p in sorted(placed, key=lambda p: (p.task_id, p.repetition))] == list(range(500))


def test_phases(spark):
    steps = ["INTAKE", "INTAKE", "LOCALIZE", "IMPACT", "EDIT", "VERIFY", "REVIEW", "FINALIZE", "EDIT"]
    rows = [(1, i, p) for i, p in enumerate(steps)] + [(2, 0, "EDIT"), (3, 0, "INTAKE"), (3, 1, "NOWHERE"), (3, 2, "LOCALIZE")]
    got = sorted(tuple(r) for r in results.phase_faults(spark.createDataFrame(rows, "task int, seq int, phase string")).collect())
    assert got == [(1, 4, "IMPACT", "EDIT"), (1, 8, "FINALIZE", "EDIT"), (2, 0, None, "EDIT"), (3, 1, "INTAKE", "NOWHERE"), (3, 2, "NOWHERE", "LOCALIZE")]


@pytest.mark.parametrize("who,granted", [(None, False), ("a", True)])
def test_lease_needs_a_holder(spark, who, granted):
    asked = spark.createDataFrame([("w", 1, 0, who, "renew"), ("w", 2, 1, who, "acquire"), ("w", 3, 2, who, "renew")], "worktree string, seq int, at int, who string, op string")
    assert [r.granted for r in journal.lease_log(asked).orderBy("seq").collect()] == [False, granted, granted]
