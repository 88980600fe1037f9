"""The index of repositories over runs that change one, are repeated, or were stopped; folder trees and logs as tables."""

import pytest
from pyspark.sql import functions as F

from skeinwork.operators import indexing
from skeinwork.plans.indexes import line_terms
from skeinwork.sources import trees

FILES = [("a", "x.md", "One two\nThree One"), ("a", "d/y.md", "Two x One"), ("b", "x.md", "One two\nThree One"), ("b", "s.sql", "create table Users (id int); select * from users join gone"), ("c", "z.md", "Z")]


def files(spark, rows):
    made = spark.createDataFrame(rows, "repository string, path string, text string")
    return made.select("repository", "path", F.sha2("text", 256).alias("hash"), F.when(F.col("path").endswith(".sql"), "sql").otherwise("markdown").alias("language"), F.octet_length("text").cast("long").alias("size"), "text")


@pytest.fixture
def calls():
    return []


@pytest.fixture
def index(spark, tmp_path, calls):
    def facts(contents):
        calls.append(sorted(r.text for r in contents.select("text").collect()))
        return line_terms(contents)

    return indexing.Index(spark, f"file://{tmp_path}/index", (indexing.Analyzer("terms", ("markdown",), facts), indexing.Analyzer("sql", ("sql",), indexing.sql_analyzer)))


def nodes(index, repository):
    return sorted((r.kind, r.fqn, r.path) for r in index.nodes.read([repository]).collect())


def edges(index, repository):
    names = {r.node_id: r.fqn for r in index.nodes.read().collect()}
    return sorted((names[r.src], names[r.dst], r.kind) for r in index.edges.read([repository]).collect())


def test_what_is_made_of_files(spark, index):
    assert index.index(files(spark, FILES)) == ["a", "b", "c"]
    assert nodes(index, "a") == [("directory", "a", None), ("directory", "a/d", None), ("file", "a/d/y.md", "d/y.md"), ("file", "a/x.md", "x.md"), ("term", "One", "x.md"), ("term", "Three", "x.md"), ("term", "Two", "d/y.md")]
    assert edges(index, "a") == [("a", "a/d", "contains"), ("a", "a/x.md", "contains"), ("a/d", "a/d/y.md", "contains"), ("a/d/y.md", "One", "references"), ("a/x.md", "One", "references")]
    assert ("b/s.sql", "users", "reads_schema") in edges(index, "b") and not [e for e in edges(index, "b") if e[1] == "gone"]
    assert index.chunks.read().count() == len(FILES)


def test_a_second_run_writes_what_changed_alone(spark, index, calls):
    index.index(files(spark, FILES))
    tables = (index.files, index.nodes, index.chunks, index.edges, index.keys)
    first = [t.state() for t in tables]
    assert index.index(files(spark, FILES)) == [] and [t.state() for t in tables] == first
    changed = [*FILES[:2], ("b", "x.md", "Four"), FILES[3], FILES[4]]
    assert index.index(files(spark, changed)) == ["b"]
    for t, (version, before) in zip(tables, first, strict=True):
        now = t.state()
        assert now[0] == version + 1 and {p for p in now[1]["parts"] if now[1]["parts"][p] != before["parts"].get(p)} == {"b"}
    assert ("term", "Four", "x.md") in nodes(index, "b") and ("term", "Three", "x.md") not in nodes(index, "b")
    assert calls == [["One two\nThree One", "Two x One", "Z"], ["Four"]]  # a content is analysed once, whoever has it
    assert index.index(files(spark, changed[:4])) == ["c"]  # a repository that is no more
    assert index.nodes.read(["c"]).count() == index.keys.read(["c"]).count() == 0


def test_dirty_repositories_are_made_anew(spark, index):
    index.index(files(spark, FILES))
    dirty = spark.createDataFrame([("c",), ("new",)], "repository string")
    assert index.mark_dirty(dirty, "batch-1") and not index.mark_dirty(dirty, "batch-1")
    assert sorted((r.repository, r.dirty) for r in index.keys.read().collect()) == [("a", False), ("b", False), ("c", True), ("new", True)]
    assert index.index(files(spark, FILES)) == ["c", "new"]
    assert sorted((r.repository, r.dirty) for r in index.keys.read().collect()) == [("a", False), ("b", False), ("c", False)]


def test_a_run_that_was_stopped_goes_on(spark, index, monkeypatch):
    lost = index.edges.replace

    def stops(*args, **more):
        raise RuntimeError("lost")

    monkeypatch.setattr(index.edges, "replace", stops)
    with pytest.raises(RuntimeError):
        index.index(files(spark, FILES))
    written = index.nodes.state()
    assert index.keys.read().count() == 0
    monkeypatch.setattr(index.edges, "replace", lost)
    assert index.index(files(spark, FILES)) == ["a", "b", "c"]
    assert index.nodes.state() == written  # what was there is not written again
    assert len(edges(index, "a")) == 5 and index.keys.read().count() == 3


def test_tree(spark, tmp_path):
    root = tmp_path / "tree é"
    for name, content in {"a.go": b"package a", "sub/b.py": "é".encode(), "sub/.env": b"x", "sub/k.pem": b"x", "vendor/c.go": b"x", "sub/vendor/d.go": b"x", "big.txt": b"x" * 2000, "bin": b"a\0b", "odd": b"\x10\x0a", "late": b"x" * 9000 + b"\0"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    rows = {r.path: r for r in trees.tree(spark, str(root), most=1000).collect()}
    assert {p: r.skipped for p, r in rows.items()} == {"a.go": None, "sub/b.py": None, "sub/k.pem": "sensitive", "vendor/c.go": "excluded", "sub/vendor/d.go": "excluded", "big.txt": "too_large", "bin": "binary", "odd": None, "late": "too_large"}
    assert rows["sub/b.py"].text == "é" and rows["a.go"].language == "go" and rows["bin"].text is None
    assert trees.tree(spark, str(root), most=10_000).filter("path = 'late'").first().skipped is None  # a zero byte after the first 8 KiB


def test_commits_of_a_log(spark, tmp_path):
    (tmp_path / "log").write_text("\x1eh1\x1fann\x1f100\x1fone: two\x1f\na.go\nb/c.go\n\n\x1eh2\x1fbob\x1fx\x1f\x1f\n\x1ebroken\x1fx\n")
    rows = [tuple(r) for r in trees.commits(spark, f"{tmp_path}/log").collect()]
    assert rows == [("h1", "ann", 100, "one: two", ["a.go", "b/c.go"]), ("h2", "bob", None, "", [])]


def test_a_content_is_analysed_once_a_run(spark, tmp_path):
    """What the analyzers say is worked out once, however often it is read while it is merged."""
    seen = spark.sparkContext.accumulator(0)

    def counted(text):
        seen.add(1)
        return text

    def facts(contents):
        return line_terms(contents.select("hash", F.udf(counted, "string").asNondeterministic()("text").alias("text")))

    index = indexing.Index(spark, f"file://{tmp_path}/index", (indexing.Analyzer("terms", ("markdown",), facts),))
    index.index(files(spark, [("a", "x.md", "One two"), ("a", "y.md", "Two One"), ("b", "x.md", "One two")]))
    assert seen.value == 2
