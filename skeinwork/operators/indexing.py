"""The index of repositories: files, nodes, chunks, edges and keys, of which only what changed is made anew."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import Scratch
from ..sources.sinks import Table
from .checks import derived_id
from .failures import sql_tables
from .graph import file_tree
from .journal import manifest
from .packing import line_chunks

#: Version of what the index makes of a file; another one makes everything anew.
VERSION = 1
#: What an analyzer says of a content: a declaration has kind and name, a reference also the kind of its edge and its evidence.
FACTS = "hash string, fact string, kind string, name string, line int, edge string, evidence string"


@dataclass(frozen=True)
class Analyzer:
    """facts makes FACTS of distinct contents (hash, text) of the languages; its version is part of what is kept of it."""

    name: str
    languages: tuple[str, ...]
    facts: Callable[[DataFrame], DataFrame]
    version: int = 1


def sql_analyzer(contents: DataFrame) -> DataFrame:
    """Tables that a script creates and those that its statements name."""
    made = F.regexp_extract_all("text", F.lit(r"(?i)\bcreate\s+table\s+(?:if\s+not\s+exists\s+)?([A-Za-z_][A-Za-z0-9_.]*)"), F.lit(1))
    none = lambda t: F.lit(None).cast(t)
    declared = contents.select("hash", F.lit("declare").alias("fact"), F.lit("table").alias("kind"), F.explode(F.array_distinct(F.transform(made, lambda n: F.lower(n)))).alias("name"), none("int").alias("line"), none("string").alias("edge"), none("string").alias("evidence"))
    statements = contents.select("hash", F.explode(F.split("text", ";")).alias("s"))
    named = statements.select("hash", F.explode(sql_tables(F.col("s"))).alias("name")).select("hash", F.lower("name").alias("name")).distinct()
    return declared.unionByName(named.select("hash", F.lit("refer").alias("fact"), F.lit("table").alias("kind"), "name", none("int").alias("line"), F.lit("reads_schema").alias("edge"), F.lit("declared").alias("evidence")))


def node_id(repository: Column, kind: Column, fqn: Column) -> Column:
    return derived_id(repository, kind, fqn)


class Index:
    """Five tables of one folder, by repository, and what analyzers said of each content.

    index() does, for the repositories whose content is not what their key says: files, then nodes and chunks, then edges, which
    need the nodes of all analyzers, then the key. Each step is a commit of its table, named after the content it comes from. So
    a run that was stopped goes on where it was, a second run over the same content writes nothing, and one over a changed
    repository writes that repository alone.
    """

    def __init__(self, spark: SparkSession, folder: str, analyzers: tuple[Analyzer, ...] = (Analyzer("sql", ("sql",), sql_analyzer),), lines: int = 60):
        self.spark, self.analyzers, self.lines = spark, analyzers, lines
        table = lambda name, schema, key: Table(spark, f"{folder}/{name}", schema, key, by="repository")
        self.files = table("files", "repository string, path string, hash string, language string, size long", ["repository", "path"])
        self.nodes = table("nodes", "repository string, node_id string, kind string, fqn string, path string, line int, source string", ["node_id"])
        self.chunks = table("chunks", "repository string, path string, first int, last int, hash string", ["repository", "path", "first"])
        self.edges = table("edges", "repository string, src string, dst string, kind string, evidence string, source string", ["src", "dst", "kind", "source"])
        self.keys = table("keys", "repository string, manifest string, version int, dirty boolean", ["repository"])
        self.memo = Table(spark, f"{folder}/memo", f"analyzer string, {FACTS}", ["analyzer", "hash", "fact", "kind", "name"], buckets=16)
        self.seen = Table(spark, f"{folder}/seen", "analyzer string, hash string", ["analyzer", "hash"], buckets=16)

    def mark_dirty(self, repositories: DataFrame, txn: str | None = None) -> bool:
        """Have the next index() make these repositories (repository) anew, whatever their content; ones not yet known too."""
        wanted = repositories.select("repository").distinct()
        rows = wanted.join(self.keys.read(), "repository", "left").select("repository", F.coalesce("manifest", F.lit("")).alias("manifest"), F.coalesce("version", F.lit(VERSION)).alias("version"), F.lit(True).alias("dirty"))
        return self.keys.upsert(rows, txn)

    def stale(self, files: DataFrame) -> dict[str, str]:
        """Repositories to make anew, with the manifest of their files as they are: of another content or version, dirty, or gone."""
        now = manifest(files.select(F.col("repository").alias("tree"), "path", "hash")).select(F.col("tree").alias("repository"), F.col("digest").alias("now"))
        both = now.join(self.keys.read(), "repository", "full")
        same = (F.col("manifest") == F.col("now")) & (F.col("version") == VERSION) & ~F.col("dirty")
        return {r.repository: r.now or "" for r in both.filter(~F.coalesce(same, F.lit(False))).select("repository", "now").collect()}

    def _facts(self, contents: DataFrame, run: str) -> DataFrame:
        """What the analyzers say of contents (hash, language, text): said once for each content, kept, and read from there."""
        out = None
        for a in self.analyzers:
            name = f"{a.name}/{a.version}"
            mine = contents.filter(F.col("language").isin(*a.languages)).select("hash", "text").dropDuplicates(["hash"])
            known = self.seen.read().filter(F.col("analyzer") == name).select("hash")
            new = mine.join(known, "hash", "left_anti")
            said = a.facts(new).withColumn("analyzer", F.lit(name)).groupBy("analyzer", "hash", "fact", "kind", "name").agg(F.min("line").alias("line"), F.min("edge").alias("edge"), F.min("evidence").alias("evidence"))
            # written before it is merged, which reads it more than once: texts are dealt and analysed once
            scratch = Scratch(self.spark, "facts")
            self.memo.upsert(scratch.write(said, "said"), f"{run}:{name}")
            scratch.drop()
            self.seen.upsert(new.select(F.lit(name).alias("analyzer"), "hash"), f"{run}:{name}")
            facts = self.memo.read().filter(F.col("analyzer") == name).join(mine.select("hash"), "hash", "left_semi")
            out = facts if out is None else out.unionByName(facts)
        return out

    def index(self, files: DataFrame) -> list[str]:
        """Bring the index up to files (repository, path, hash, language, size, text), one row each. Gives the repositories it made anew."""
        found = self.stale(files)
        if not found:
            return []
        names = sorted(found)
        run = hashlib.sha256(repr((VERSION, sorted(found.items()), self.keys.state()[0])).encode()).hexdigest()[:16]
        mine = files.filter(F.col("repository").isin(names))
        self.files.replace(mine.select("repository", "path", "hash", "language", "size"), names, run)
        chunks = line_chunks(mine.select(F.struct("repository", "path").alias("doc_id"), "text"), self.lines)
        self.chunks.replace(chunks.select("doc_id.*", "first", "last", F.sha2("body", 256).alias("hash")), names, run)

        tree = file_tree(mine.select(F.concat_ws("/", "repository", "path").alias("path")))
        placed = tree.withColumn("repository", F.substring_index("child", "/", 1))
        kept = self.files.read(names)
        facts = self._facts(mine.select("hash", "language", "text"), run).join(kept.select("repository", "path", "hash"), "hash")
        none = lambda t: F.lit(None).cast(t)
        folders = placed.select("repository", "kind", F.col("child").alias("fqn"), F.when(F.col("kind") == "file", F.expr("substring(child, length(repository) + 2)")).alias("path"), none("int").alias("line"), F.lit("files").alias("source"))
        declared = facts.filter("fact = 'declare'").select("repository", "kind", F.col("name").alias("fqn"), "path", "line", F.col("analyzer").alias("source"))
        # what several files declare is one node, of the first of them
        first = folders.unionByName(declared).groupBy("repository", "kind", "fqn").agg(F.min(F.struct("path", "line", "source")).alias("at"))
        self.nodes.replace(first.select("repository", node_id(F.col("repository"), F.col("kind"), F.col("fqn")).alias("node_id"), "kind", "fqn", "at.*"), names, run)

        ident = lambda kind, fqn: node_id(F.col("repository"), kind, fqn)
        contains = placed.filter("parent <> ''").select("repository", ident(F.lit("directory"), F.col("parent")).alias("src"), ident(F.col("kind"), F.col("child")).alias("dst"), F.lit("contains").alias("kind"), F.lit("resolved").alias("evidence"), F.lit("files").alias("source"))
        refers = facts.filter("fact = 'refer'").select("repository", ident(F.lit("file"), F.concat_ws("/", "repository", "path")).alias("src"), F.col("kind").alias("target"), "name", F.col("edge").alias("kind"), F.when(F.coalesce("evidence", F.lit("")) == "", "unknown").otherwise(F.col("evidence")).alias("evidence"), F.col("analyzer").alias("source"))
        # a target is looked for in its own repository; one that it does not have is left out
        known = self.nodes.read(names).select("repository", F.col("node_id").alias("dst"), F.col("kind").alias("target"), F.col("fqn").alias("name"))
        edges = contains.unionByName(refers.join(known, ["repository", "target", "name"]).select("repository", "src", "dst", "kind", "evidence", "source"))
        self.edges.replace(edges.groupBy("repository", "src", "dst", "kind", "source").agg(F.min("evidence").alias("evidence")).select("repository", "src", "dst", "kind", "evidence", "source"), names, run)

        alive = self.spark.createDataFrame([(r, m, VERSION, False) for r, m in found.items() if m], "repository string, manifest string, version int, dirty boolean")
        self.keys.replace(alive, names, run)
        return names
