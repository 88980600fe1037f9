"""Tables that are written more than once: what is in them after writes, killed writes and repeated ones."""

import pytest
from pyspark.sql import functions as F

from skeinwork.sources import sinks

ROWS = [(1, "a", 1.0), (2, "b", 2.0), (3, "c/d é=", 3.0), (4, "b", None)]


@pytest.fixture
def table(spark, tmp_path):
    return sinks.Table(spark, f"file://{tmp_path}/t", "id long, scope string, x double", ["id"], buckets=4)


def rows(t):
    return sorted(tuple(r) for r in t.read().collect())


def frame(spark, data):
    return spark.createDataFrame(data, "id long, scope string, x double")


def test_upsert_insert_and_delete(spark, table):
    assert rows(table) == []
    assert table.upsert(frame(spark, ROWS)) and rows(table) == ROWS
    table.upsert(frame(spark, [(2, "new", 9.0), (5, "e", 5.0)]))
    assert rows(table) == [ROWS[0], (2, "new", 9.0), *ROWS[2:], (5, "e", 5.0)]
    late = spark.createDataFrame([(5, "no", 0.0, 1), (6, "late", 1.0, 2), (6, "first", 7.0, 1)], "id long, scope string, x double, at int")
    table.insert(late, "at")
    assert rows(table)[-2:] == [(5, "e", 5.0), (6, "first", 7.0)]
    table.delete(F.col("x") > 4)
    assert [r[0] for r in rows(table)] == [1, 3, 4]  # null is not over 4
    assert not table.delete(F.col("id") == 99)
    table.delete(F.lit(True))
    assert rows(table) == []


def test_replace_touches_its_parts_alone(spark, tmp_path):
    t = sinks.Table(spark, f"file://{tmp_path}/t", "id long, scope string, x double", ["id"], by="scope")
    t.replace(frame(spark, ROWS))
    before = t.state()[1]["parts"]
    assert set(before) == {"a", "b", "c/d é="}
    t.replace(frame(spark, [(7, "b", 7.0)]))
    after = t.state()[1]["parts"]
    assert {p for p in after if after[p] != before[p]} == {"b"} and rows(t) == [ROWS[0], ROWS[2], (7, "b", 7.0)]
    t.replace(frame(spark, []), parts=["a"])
    assert rows(t) == [ROWS[2], (7, "b", 7.0)]
    assert [r.id for r in t.read(["b"]).collect()] == [7]
    assert t.vacuum() > 0 and rows(t) == [ROWS[2], (7, "b", 7.0)]


def test_killed_and_repeated_write_equals_one(spark, table):
    table.upsert(frame(spark, ROWS))

    def dies(batches):
        for b in batches:
            yield b
        raise RuntimeError("lost")

    new = frame(spark, [(i, "n", float(i)) for i in range(3, 40)])
    broken = new.mapInPandas(dies, new.schema)
    with pytest.raises(Exception, match="lost"):
        table.upsert(broken, "batch-1")
    assert rows(table) == ROWS
    assert table.upsert(new, "batch-1")
    once = rows(table)
    assert len(once) == 39 and not table.upsert(frame(spark, [(1, "again", 0.0)]), "batch-1") and rows(table) == once


def test_second_writer_is_refused(spark, table):
    table.upsert(frame(spark, ROWS))
    version, entry = table.state()
    table.upsert(frame(spark, [(9, "z", 0.0)]))
    with pytest.raises(RuntimeError):
        table._put(frame(spark, [(8, "y", 0.0)]), ["0"], version, entry, None)
    assert 9 in [r[0] for r in rows(table)]


def test_delete_takes_edges_along(spark, tmp_path):
    edges = sinks.Table(spark, f"file://{tmp_path}/e", "src long, dst long", ["src", "dst"], buckets=3)
    edges.upsert(spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 1)], "src long, dst long"))
    edges.delete_dangling(["src", "dst"], spark.createDataFrame([(1,), (2,), (3,)], "node_id long"), "node_id")
    assert sorted(tuple(r) for r in edges.read().collect()) == [(1, 2), (2, 3)]
