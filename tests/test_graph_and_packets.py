"""Walks with a cap, verdicts of changes, and packets under each of their caps."""

import pytest
from pyspark.sql import functions as F

from skeinwork.operators import graph, packets


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, kind string, rank int")


def start(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node_id long")


@pytest.fixture(scope="module")
def hub(spark):
    """1 <- 100 nodes <- 100 nodes each <- ..."""
    rows = [(100 + i, 1, "calls", 0) for i in range(100)] + [(1000 + 100 * i + j, 100 + i, "calls", 1) for i in range(10) for j in range(100)]
    return edges(spark, rows)


@pytest.mark.parametrize("most,reached,truncated", [(1, 1, True), (50, 50, True), (101, 101, True), (102, 102, True), (1100, 1100, True), (1101, 1101, False), (5000, 1101, False)])
def test_walk_stops_at_its_cap(spark, hub, monkeypatch, most, reached, truncated):
    written = []
    settled = graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: written.append(settled(df)) or written[-1])
    found = graph.walk(hub, start(spark, 1), 6, reverse=True, most=most)
    rows = sorted((r.depth, r.node_id) for r in found.reached.collect())
    assert (len(rows), found.truncated) == (reached, truncated)
    assert rows == ([(0, 1)] + [(1, 100 + i) for i in range(100)] + [(2, 1000 + i) for i in range(1000)])[:reached]
    assert max(df.count() for df in written) <= most + 1  # no level is written beyond the cap and one
    assert len(written) <= 1 + (reached > 1) + (reached > 101) + (not truncated)


def test_walk_of_a_cycle_and_of_two_paths(spark):
    e = edges(spark, [(1, 2, "calls", 0), (2, 3, "calls", 4), (1, 4, "imports", 1), (4, 3, "reads", 1), (3, 1, "calls", 0)])
    assert sorted(tuple(r) for r in graph.walk(e, start(spark, 1, 1), 6).reached.collect()) == [(1, 0, 0, None), (2, 1, 0, "calls"), (3, 2, 1, "reads"), (4, 1, 1, "imports")]
    for depth in (0, 7):
        with pytest.raises(ValueError):
            graph.walk(e, start(spark, 1), depth)


def test_stored_edges_read_the_frontiers_buckets_alone(spark, hub, tmp_path):
    stored = graph.Adjacency(spark, f"file://{tmp_path}/adjacency", 16).write(hub)
    near = stored.at(start(spark, 1), "dst")
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]  # a filter on folders, not on rows
    assert 100 <= near.count() < hub.count()
    for reverse, first in ((True, 1), (False, 1005)):
        a = graph.walk(stored, start(spark, first), 3, reverse=reverse).reached
        b = graph.walk(hub, start(spark, first), 3, reverse=reverse).reached
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


#: change, edge, evidence (0 resolved, 2 inferred), verdict
VERDICTS = [
    ("remove", "contains", 0, "breaking"), ("remove", "calls", 2, "undetermined"), ("rename", "reads_config", 1, "breaking"), ("rename", "tests", 0, "compiles"),
    ("signature", "returns", 0, "breaking"), ("signature", "uses_type", 0, "compiles"), ("add_field", "uses_type", 0, "compiles"), ("add_field", "implements", 0, "breaking"),
    ("add_field", "calls", 0, "compatible"), ("behaviour", "tests", 0, "breaking"), ("behaviour", "calls", 1, "compiles"), ("schema", "writes_schema", 0, "breaking"),
    ("schema", "calls", 0, "compiles"), ("config", "deploys", 0, "breaking"), ("config", "calls", 0, "compiles"), ("route", "handles", 0, "breaking"), ("route", "references", 4, "undetermined"), ("route", "calls", 0, "compiles"),
]


def test_verdicts_of_changes(spark):
    consumers = spark.createDataFrame([(i, via, rank) for i, (_, via, rank, _) in enumerate(VERDICTS)], "node_id long, via string, rank int")
    changes = spark.createDataFrame([(c,) for c in graph.DEFAULTS], "change string")
    got = {(r.change, r.node_id): r for r in graph.judged(consumers, changes).collect()}
    assert len(got) == len(VERDICTS) * 8
    for i, (change, _, rank, verdict) in enumerate(VERDICTS):
        r = got[change, i]
        assert r.verdict == verdict, (change, VERDICTS[i])
        assert (r.step == "") == ((change, verdict) in (("add_field", "compatible"), ("config", "compiles"), ("route", "compiles")))
        assert "check by hand" in r.step if rank > 1 else "check by hand" not in r.step


def test_report_is_in_reading_order(spark):
    e = edges(spark, [(2, 1, "tests", 0), (3, 1, "calls", 0), (4, 1, "calls", 3), (5, 3, "tests", 0), (6, 1, "tests", 0)])
    nodes = spark.createDataFrame([(i, "func", f"f{i}", {2: "z.go", 6: "b.go"}.get(i)) for i in range(1, 7)], "node_id long, kind string, fqn string, path string")
    rows = graph.impact_lines(e, nodes, start(spark, 1), "behaviour").orderBy("place").collect()
    assert [(r.node_id, r.verdict, r.path, r.evidence) for r in rows] == [(6, "breaking", "b.go", "resolved"), (2, "breaking", "z.go", "resolved"), (5, "breaking", "", "resolved"), (4, "undetermined", "", "observed"), (3, "compiles", "", "resolved")]
    assert not rows[0].truncated and rows[0].caveat == graph.CAVEAT
    few = graph.impact_lines(e, nodes, start(spark, 1), "behaviour", most=3).collect()
    assert len(few) == 2 and few[0].truncated
    with pytest.raises(ValueError):
        graph.impact_lines(e, nodes, start(spark, 1), "nothing")


ITEM = "packet long, origin string, seq long, score double, kind string, stale string, node_id long, workspace string, repository string, path string, hash string, version int, cost long"


def packet(spark, items, budget=1000):
    """Verdicts by seq of one packet's items, each (origin, cost) or (origin, cost, more columns)."""
    base = {"packet": 1, "score": 0.0, "kind": None, "stale": None, "node_id": None, "workspace": "w", "repository": "r", "path": "p", "hash": "h", "version": 1}
    rows = [base | {"seq": i, "origin": o, "cost": c, **(more[0] if more else {})} for i, (o, c, *more) in enumerate(items)]
    names = [f.split()[0] for f in ITEM.split(", ")]
    requests = spark.createDataFrame([(1, "w", budget), (2, "w", 10)], "packet long, workspace string, budget long")
    out = packets.assemble(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ITEM), requests)
    totals = {r.packet: r for r in packets.packet_totals(out, requests).collect()}
    assert totals[2].tokens == totals[2].slices == 0  # asked for, without items
    return {r.seq: r.verdict for r in out.collect()}, totals[1]


def test_an_item_that_does_not_fit_is_passed_and_the_next_tried(spark):
    got, totals = packet(spark, [("anchor", c, {"score": -float(i)}) for i, c in enumerate((5, 8, 3, 9, 2))], 10)
    assert got == {0: "kept", 1: "budget", 2: "kept", 3: "budget", 4: "kept"}
    assert (totals.tokens, totals.slices, totals.dropped) == (10, 3, 2)


def test_impact_is_charged_and_never_left_out(spark):
    got, totals = packet(spark, [("impact", 900), ("impact", 900), ("anchor", 10)])
    assert got == {0: "kept", 1: "kept", 2: "budget"} and totals.tokens == 1800


def test_graph_has_a_third_and_notes_a_share_each(spark):
    got, totals = packet(spark, [("graph", 200, {"score": 0.5}), ("graph", 200, {"score": 0.4}), ("graph", 130, {"score": 0.3}), ("note", 100, {"kind": "advice"}), ("note", 60, {"kind": "intent"}), ("note", 90, {"kind": "advice"}), ("project_note", 150), ("project_note", 1)])
    assert got == {0: "kept", 1: "graph_share", 2: "kept", 3: "note_share", 4: "kept", 5: "kept", 6: "kept", 7: "note_share"}
    assert (totals.tokens, totals.notes, totals.notes_dropped, totals.dropped) == (630, 3, 2, 1)


def test_best_first_in_an_origin_and_first_of_a_node(spark):
    got, _ = packet(spark, [("graph", 100, {"score": 0.9, "node_id": 7}), ("explicit", 100, {"score": 0.1, "node_id": 7}), ("anchor", 600, {"score": 1.0}), ("anchor", 600, {"score": 2.0}), ("impact", 5, {"node_id": 8}), ("graph", 5, {"node_id": 8}), ("explicit", 350, {"node_id": 9}), ("graph", 5, {"node_id": 9})])
    assert got == {0: "repeat", 1: "kept", 2: "budget", 3: "kept", 4: "kept", 5: "repeat", 6: "budget", 7: "repeat"}


def test_foreign_invalid_sensitive_and_stale(spark):
    got, totals = packet(spark, [("anchor", 5, {"workspace": "x"}), ("impact", 5, {"hash": ""}), ("impact", 5, {"path": "a/.env.local"}), ("project_note", 5, {"stale": "source"}), ("note", 5, {"workspace": None, "kind": "intent"}), ("graph", 5, {"version": 0})])
    assert got == {0: "foreign", 1: "invalid", 2: "sensitive", 3: "stale", 4: "kept", 5: "invalid"}
    assert (totals.rejected, totals.dropped, totals.notes_dropped) == (3, 1, 1)


def test_stale_notes(spark):
    rows = [(1, "r", "c", 5, "user", ["f"]), (2, "x", "c", 5, "user", []), (3, "r", "", 5, "tool", []), (4, "r", "c", None, "user", []), (5, "x", "c", 5, "model", []), (6, "r", "c", 5, "model_accepted", ["f", "gone", "also"])]
    notes = spark.createDataFrame(rows, "note_id long, repository string, commit string, updated_at long, source string, symbols array<string>")
    got = {r.note_id: r.stale for r in packets.stale_notes(notes, "r", spark.createDataFrame([("f",)], "name string")).collect()}
    assert got == {1: None, 2: "provenance", 3: "provenance", 4: "provenance", 5: "source", 6: "symbol:gone"}


def test_token_estimates(spark):
    t = spark.createDataFrame([("é" * 5,), (None,), ("",)], "t string")
    got = [tuple(r) for r in t.select(packets.slice_tokens(F.col("t"), F.lit("ab")), packets.message_tokens(F.col("t")), packets.map_entry_tokens(F.col("t")), packets.project_note_tokens(F.col("t"))).collect()]
    assert got == [(11, 3, 23, 103), (8, 1, 20, 100), (8, 1, 20, 100)]
