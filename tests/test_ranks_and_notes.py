"""PageRank, vector search in blocks, note cards and report texts against brute force."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinwork.operators import graph, matching, packing, results, retrieval
from skeinwork.sources import notes


def test_pagerank(spark):
    rng = random.Random(4)
    nodes = list(range(40))
    links = [(rng.choice(nodes[:30]), rng.choice(nodes)) for _ in range(120)] + [(1, 2), (1, 2)]  # some have no link, some two to one node
    out = {n: [d for s, d in links if s == n] for n in nodes}
    score = dict.fromkeys(nodes, 1 / 40)
    for _ in range(7):
        idle = sum(score[n] for n in nodes if not out[n])
        new = dict.fromkeys(nodes, 0.15 / 40 + 0.85 * idle / 40)
        for n in nodes:
            for d in out[n]:
                new[d] += 0.85 * score[n] / len(out[n])
        score = new
    table = spark.createDataFrame([(n,) for n in nodes], "node_id long")
    got = {r.node_id: r.score for r in graph.pagerank(table, spark.createDataFrame(links, "src long, dst long"), 7).collect()}
    assert got == pytest.approx(score) and sum(got.values()) == pytest.approx(1)
    assert graph.pagerank(table.limit(0), spark.createDataFrame([], "src long, dst long")).count() == 0


def test_pagerank_rounds_go_over_linked_nodes_alone(spark, monkeypatch):
    written = {}

    class Counted(graph.Scratch):
        def write_bucketed(self, df, name, key, buckets):
            out = super().write_bucketed(df, name, key, buckets)
            written[name] = out.count()
            return out

    monkeypatch.setattr(graph, "Scratch", Counted)
    links = [(i, 100 + i % 3) for i in range(50)] + [(100, 101), (101, 100)]  # 102 and 103 have no links of their own, 103 none to it
    table = spark.createDataFrame([(i,) for i in [*range(50), 100, 101, 102, 103]], "node_id long")
    got = {r.node_id: r.score for r in graph.pagerank(table, spark.createDataFrame(links, "src long, dst long"), 3).collect()}
    assert sum(got.values()) == pytest.approx(1) and got[0] == got[103] < got[102]
    assert [written[f"scores-{i}"] for i in range(4)] == [3] * 4 and written["links"] == 2


@pytest.mark.parametrize("circle", [True, False])
def test_pagerank_takes_off_levels(spark, monkeypatch, circle):
    """Nodes that only levels before them link to are in no round; without a circle there is no round at all."""
    written = {}

    class Counted(graph.Scratch):
        def write_bucketed(self, df, name, key, buckets):
            out = super().write_bucketed(df, name, key, buckets)
            written[name] = out.count()
            return out

    monkeypatch.setattr(graph, "Scratch", Counted)
    links = [(i, 100 + i % 10) for i in range(35)] + [(i, 200) for i in range(100, 107)] + [(100, 201), (3, 200), (200, 201)] + [(201, 200)] * circle
    nodes, out = [*range(35), *range(100, 110), 200, 201], {}
    for s, d in links:
        out.setdefault(s, []).append(d)
    score = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(4):
        new = dict.fromkeys(nodes, (0.15 + 0.85 * sum(score[n] for n in nodes if n not in out)) / len(nodes))
        for s, ds in out.items():
            for d in ds:
                new[d] += 0.85 * score[s] / len(ds)
        score = new
    table = spark.createDataFrame([(n,) for n in nodes], "node_id long")
    got = {r.node_id: r.score for r in graph.pagerank(table, spark.createDataFrame(links, "src long, dst long"), 4).collect()}
    assert got == pytest.approx(score, rel=1e-12) and sum(got.values()) == pytest.approx(1)
    assert [n for name, n in written.items() if name.startswith("scores")] == ([2] * 5 if circle else [])


def test_greedy_fill_reads_what_could_fit(spark):
    rng = random.Random(7)
    rows = [(p, i, rng.choice([0, 3, 4, 9, 40, 101])) for p in range(3) for i in range(400)]
    want = []
    for p in range(3):
        used = 0
        for _, i, cost in rows[400 * p:400 * p + 400]:
            if used + cost <= 100:
                used += cost
                want.append((p, i, cost, used))
    items = spark.createDataFrame(rows, "packet long, seq long, cost long").repartition(5)
    assert sorted(tuple(r) for r in packing.greedy_fill(items, 100).collect()) == want
    left = packing.could_fit(items, 100, "seq")
    most = {3: 33, 4: 25, 9: 11, 40: 2}
    assert {(r.packet, r.cost): r.n for r in left.filter("cost > 0").groupBy("packet", "cost").agg(F.count("*").alias("n")).collect()} == {(p, c): n for p in range(3) for c, n in most.items()}
    with pytest.raises(Exception, match="costs -1"):
        packing.greedy_fill(spark.createDataFrame([(1, 1, -1)], "packet long, seq long, cost long"), 10).collect()


@pytest.mark.parametrize("block", [3, 1000])
def test_top_vectors(spark, block):
    rng = np.random.default_rng(2)
    data = rng.integers(-3, 4, (150, 6)).astype(float)  # many equal products
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)] + [(999, None)], "vec_id long, embedding array<float>").repartition(7)
    queries = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    got = sorted(tuple(r) for r in retrieval.top_vectors(vectors, queries, block).collect())
    dots = data @ data[::20].T
    assert got == [(20 * k, int(np.flatnonzero(dots[:, k] == dots[:, k].max())[0]), dots[:, k].max()) for k in range(8)]
    assert retrieval.top_vectors(vectors, queries.limit(0)).count() == 0


def test_cards(spark, tmp_path):
    (tmp_path / "project.md").write_text("---\nrepo_id: r1\ncommit: 'abc'\nupdated_at: 2024-01-02T03:04:05Z\nsource: user\nsymbols: [A.f, \"B\"]\n---\n Text of it\n---\nmore\n")
    (tmp_path / "decisions.md").write_text("---\ncommit: x\nupdated_at: soon\nsymbols:\n  - One\n  - Two\n---\nbody")
    (tmp_path / "glossary.md").write_text("no head")
    (tmp_path / "constraints.md").write_text("---\n---\n" + "x" * 17_000)
    (tmp_path / "other.md").write_text("---\n---\nnot a card")
    found, rejects = notes.cards(spark, str(tmp_path))
    got = {r.note_id: r for r in found.collect()}
    p, d = got["project"], got["decisions"]
    assert set(got) == {"project", "decisions"}
    assert (p.repository, p.commit, p.updated_at, p.source, p.symbols, p.text) == ("r1", "abc", 1704164645, "user", ["A.f", "B"], "Text of it\n---\nmore")
    assert (d.repository, d.updated_at, d.source, d.symbols, d.text) == (None, None, None, ["One", "Two"], "body")
    assert {(r.file.rsplit("/", 1)[1], r.reason) for r in rejects.collect()} == {("glossary.md", "no_head"), ("constraints.md", "too_large")}


def test_json_summaries(spark):
    cases = {
        None: "", "": "", " null ": "", "{}": "", '{"b":1,"a":"x\\ny"}': "a=x y  b=1", '{"l":[1,[2]],"o":{"z":1},"n":null,"t":false,"f":2.5}': "f=2.5  l[2]  n=null  o{…}  t=false",
        "plain  text\nhere": "plain  text here", "x" * 130: "x" * 120 + "…", "[1,2]": "[1,2]", json.dumps({"k": "y" * 70}): "k=" + "y" * 60 + "…",
    }
    got = {r.t: r.s for r in spark.createDataFrame([(c,) for c in cases], "t string").select("t", results.json_summary(F.col("t")).alias("s")).collect()}
    assert got == cases


def test_rate_texts_and_markdown(spark):
    rows = spark.createDataFrame([("a", 1, 3), ("b|c", 0, 0)], "arm string, k long, n long").select("arm", results.rate_text(F.col("k"), F.col("n")).alias("rate"))
    assert [r.rate for r in rows.orderBy("arm").collect()] == ["33% (1/3) [6–79%]", "—"]
    assert results.markdown(rows, ["arm"]) == "| arm | rate |\n| --- | --- |\n| a | 33% (1/3) [6–79%] |\n| b\\|c | — |\n"


def test_shown_lines(spark):
    text = "\n".join(f"l{i}" for i in range(1, 21))
    files = spark.createDataFrame([(1, text), (2, text), (3, text), (4, None), (5, text)], "file_id long, text string")
    spans = spark.createDataFrame([(1, 5, 5), (1, 7, 6), (1, 0, 9), (2, 1, 2), (2, 12, 12), (3, 18, 40), (5, 90, 95)], "file_id long, first long, last long")
    got = {r.file_id: r.body.split("\n") for r in matching.shown_lines(files, spans, margin=1, first=2).collect()}
    gap = matching.LEFT_OUT
    assert got[1] == [gap, "4: l4", "5: l5", "6: l6", gap]
    assert got[2] == ["1: l1", "2: l2", "3: l3", gap, "11: l11", "12: l12", "13: l13", gap]
    assert got[3] == [gap, "17: l17", "18: l18", "19: l19", "20: l20"] and got[4] == ["1: "] and got[5] == [gap]


def test_hosts(spark):
    rules = spark.createDataFrame([(1, "*.Example.org", None, True), (2, "example.org", ["model"], True), (3, "*", [], True)], "rule_order int, pattern string, lanes array<string>, allow boolean")
    hosts = spark.createDataFrame([("A.example.ORG.", "web"), ("example.org", "web"), (" example.org ", "model"), ("badexample.org", "web")], "host string, lane string")
    assert {(r.host, r.lane): (r.rule_order, r.allow) for r in matching.host_rules(hosts, rules).collect()} == {("A.example.ORG.", "web"): (1, True), ("example.org", "web"): (None, False), (" example.org ", "model"): (2, True), ("badexample.org", "web"): (None, False)}


def test_graded_runs(spark):
    tests = results.hidden_tests(spark.createDataFrame([("t", "func TestA(t *testing.T) {}\n// func TestNo()\nfunc TestB (t"), ("t", "func TestA(x"), ("u", "func Helper()")], "task_id string, text string"))
    assert [(r.task_id, r.tests) for r in tests.collect()] == [("t", ["TestA", "TestB"])]
    rows = [("1", "t", True, None, None, False), ("2", "t", False, None, "x\n  --- FAIL: TestA (0s)\n--- FAIL: TestZ", False), ("3", "t", False, None, "boom", None), ("4", "t", False, "lost", "--- FAIL: TestA", None), ("5", "t", False, None, f"--- FAIL: TestA\n{results.CUT_OUTPUT}", None), ("6", "t", False, None, "--- FAIL: TestA", True), ("7", "u", True, None, "", None)]
    runs = spark.createDataFrame(rows, "run_id string, task_id string, solved boolean, error string, output string, recorded boolean").withColumn("arm", F.lit("a"))
    assert sorted((r.run_id, r.passed, r.failed, r.score) for r in results.graded_runs(runs, tests).collect()) == [("1", 2, [], 1.0), ("2", 1, ["TestA"], 0.5), ("3", 0, [], 0.0)]
