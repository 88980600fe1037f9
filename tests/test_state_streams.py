"""Streams with state: against the same rows in one batch, over a restart, and for what timers do when nothing comes."""

import datetime as dt
import time

from pyspark.sql import functions as F

from skeinwork.operators import indexing, journal
from skeinwork.streaming import state

REQUESTS = "worktree string, seq long, at timestamp, who string, op string"


def at(seconds):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=seconds)


def arrive(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def run(spark, df, tmp_path):
    """Read all that has arrived, append what comes out, and stop."""
    with state.keyed_state(spark):
        q = df.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return spark.read.parquet(f"{tmp_path}/out").collect()


def test_leases_as_the_log_over_a_restart(spark, sf_dir, tmp_path):
    asked = [("w", 1, at(0), "a", "acquire"), ("w", 2, at(10), "b", "acquire"), ("w", 3, at(20), "a", "renew"), ("v", 1, at(21), None, "acquire"), ("v", 2, at(22), "c", "acquire"), ("v", 3, at(23), "c", "release")]
    more = [("w", 4, at(79), "b", "acquire"), ("w", 5, at(80), "b", "acquire"), ("w", 6, at(81), "a", "release"), ("v", 4, at(82), "c", "renew")]
    last = [("x", 1, at(1000), "z", "acquire")]
    arrive(spark, tmp_path / "in", asked, REQUESTS)
    make = lambda: state.leases(spark.readStream.schema(REQUESTS).parquet(f"{tmp_path}/in"))
    run(spark, make(), tmp_path)
    arrive(spark, tmp_path / "in", more, REQUESTS)
    run(spark, make(), tmp_path)
    arrive(spark, tmp_path / "in", last, REQUESTS)
    rows = run(spark, make(), tmp_path)
    whole = spark.createDataFrame(asked + more + last, REQUESTS).withColumn("at", F.unix_timestamp("at"))
    want = {(r.worktree, r.seq): ("granted" if r.granted else "refused", r.holder, r.expires) for r in journal.lease_log(whole).collect()}
    got = {(r.worktree, r.seq): (r.outcome, r.holder, r.expires) for r in rows if r.outcome != "expired"}
    assert got == want
    expired = [(r.worktree, r.holder) for r in rows if r.outcome == "expired"]
    assert expired == [("w", "b")]  # b's, after 140 seconds without a request; a's was taken over, v's given back


GATES = "task string, kind string, candidate string, seq long, at timestamp, op string, by string"


def test_gates(spark, tmp_path):
    g = ("t", "apply", "c1")
    first = [(*g, 1, at(0), "ask", None), (*g, 2, at(5), "ask", None), (*g, 3, at(10), "approve", "ann"), (*g, 4, at(20), "ask", None), (*g, 5, at(21), "reject", "bob"), ("t", "apply", "", 6, at(22), "ask", None), ("u", "plan", "c", 7, at(23), "approve", "x"), ("u", "plan", "c", 8, at(24), "ask", None)]
    later = [(*g, 9, at(200), "ask", None), ("y", "plan", "c", 10, at(1000), "ask", None)]
    make = lambda: state.gates(spark.readStream.schema(GATES).parquet(f"{tmp_path}/in"), 60)
    arrive(spark, tmp_path / "in", first, GATES)
    run(spark, make(), tmp_path)
    arrive(spark, tmp_path / "in", later, GATES)
    rows = run(spark, make(), tmp_path)
    by = sorted((r.seq, r.outcome) for r in rows if r.seq is not None and r.outcome != "expired")
    assert by == [(1, "opened"), (2, "waiting"), (3, "approved"), (4, "approved"), (5, "refused"), (6, "opened"), (7, "refused"), (8, "opened"), (9, "opened"), (10, "opened")]
    assert sorted(r.gate for r in rows if r.outcome == "expired") == ["t|apply|#6", "t|apply|c1", "u|plan|c"]  # nobody answered, the second time


def test_gate_steps():
    s, out = state.gate_step(None, "ask", 0, None, 10)
    assert out == "opened" and state.gate_step(s, "approve", 11, "a", 10)[1] == "refused" and state.gate_step(s, "ask", 11, None, 10)[1] == "opened"
    s, out = state.gate_step(s, "reject", 10, "a", 10)
    assert out == "rejected" and state.gate_step(s, "ask", 10, None, 10)[1] == "rejected" and state.gate_step(s, "ask", 11, None, 10)[1] == "opened"
    s, _ = state.gate_step(None, "ask", 0, None, 0)  # without a timeout nothing expires
    assert state.gate_step(s, "approve", 10**9, "a", 0)[1] == "approved"


def test_a_burst_over_two_repositories_marks_each_once(spark, tmp_path):
    index = indexing.Index(spark, f"file://{tmp_path}/index", ())
    calls = []

    def mark(rows, txn):
        index.mark_dirty(rows, txn)
        calls.append((txn, sorted(r.repository for r in rows.collect())))

    repositories = spark.createDataFrame([("outer", "/w"), ("inner", "/w/sub"), ("other", "/o")], "repository string, root string")
    paths = ["/w/a.go"] * 50 + ["/w/sub/b.go", "/w/sub/c.go", "/w/subway/d.go", "/elsewhere/x"]
    arrive(spark, tmp_path / "in", [("root", p) for p in paths], "root string, path string")
    events = spark.readStream.schema("root string, path string").parquet(f"{tmp_path}/in")
    q = state.mark_dirty(state.bursts(events, 200), repositories, mark, f"{tmp_path}/at", "watch", {"processingTime": "300 milliseconds"})
    until = time.time() + 120
    while time.time() < until and not any(c[1] for c in calls):
        time.sleep(0.5)
    q.stop()
    marked = [c for c in calls if c[1]]
    assert [c[1] for c in marked] == [["inner", "outer"]]
    assert sorted((r.repository, r.dirty) for r in index.keys.read().collect()) == [("inner", True), ("outer", True)]
    version = index.keys.state()[0]
    mark(repositories.select("repository"), marked[0][0])  # the batch comes again
    assert index.keys.state()[0] == version
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_settings_are_put_back(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with state.keyed_state(spark):
        assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
