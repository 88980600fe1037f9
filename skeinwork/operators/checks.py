"""Checks of rows and names: units, tenants, edges that are resolved, interfaces, ids, schemas and signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seconds(value: Column) -> Column:
    """Epoch seconds of a value that may be in milliseconds: those are 1e11 or more."""
    return F.when(value >= 100_000_000_000, F.floor(value / 1000)).otherwise(value).cast("long")


def guarded(rows: DataFrame, workspace: Column, required: list[str]) -> DataFrame:
    """rows with reason: `foreign` of another workspace, `invalid` where a required field is null or empty, else null. Nothing is dropped."""
    bad = F.lit(False)
    for c in required:
        bad = bad | F.coalesce(F.col(c).cast("string"), F.lit("")).isin("")
    return rows.withColumn("reason", F.when(~F.col("workspace_id").eqNullSafe(workspace), "foreign").when(bad, "invalid"))


def resolved_edges(pending: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, evidence): pending edges by (kind, fqn) at both ends as ids; unresolved ones go, blank evidence is unknown."""
    ids = nodes.select("node_id", "kind", "fqn")
    src, dst = (ids.select(F.col("node_id").alias(e), F.col("kind").alias(f"{e}_kind"), F.col("fqn").alias(f"{e}_fqn")) for e in ("src", "dst"))
    out = pending.join(src, ["src_kind", "src_fqn"]).join(dst, ["dst_kind", "dst_fqn"])
    return out.select("src", "dst", F.when(F.coalesce("evidence", F.lit("")) == "", "unknown").otherwise(F.col("evidence")).alias("evidence")).distinct()


def inner_edges(edges: DataFrame, ranked: DataFrame) -> DataFrame:
    """Edges whose both ends are among the ranked nodes (node_id)."""
    ends = ranked.select("node_id").distinct()
    return edges.join(ends, F.col("src") == F.col("node_id"), "left_semi").join(ends, F.col("dst") == F.col("node_id"), "left_semi")


def implementers(interfaces: DataFrame, types: DataFrame) -> DataFrame:
    """(interface, type): types that have every method of an interface. interfaces: interface, method; types: type, method.

    Types meet interfaces by method and are counted, which leaves out all pairs that share none.
    """
    size = interfaces.distinct().groupBy("interface").agg(F.count("*").alias("size"))
    return interfaces.distinct().join(types.distinct(), "method").groupBy("interface", "type").agg(F.count("*").alias("n")).join(size, "interface").filter("n = size").select("interface", "type")


def match_query(text: Column) -> Column:
    """The text's terms of two signs or more, quoted and joined by OR; terms are runs of A-Z a-z 0-9 _ . / -."""
    terms = F.filter(F.split(text, r"[^A-Za-z0-9_./-]+"), lambda t: F.length(t) >= 2)
    return F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def uvarint(n: Column) -> Column:
    """A number, under 2^35, as bytes of seven bits each, the lowest first; all but the last have their top bit set."""
    digits = [F.when(n >= 1 << 7 * k, F.lpad(F.hex(F.shiftrightunsigned(n.cast("long"), 7 * k).bitwiseAND(127) + F.when(n >= 1 << 7 * (k + 1), 128).otherwise(0)), 2, "0")).otherwise("") for k in range(1, 5)]
    first = F.lpad(F.hex(n.cast("long").bitwiseAND(127) + F.when(n >= 128, 128).otherwise(0)), 2, "0")
    return F.unhex(F.concat(first, *digits))


def derived_id(*parts: Column) -> Column:
    """sha256 of the parts, each after its length in bytes as uvarint(), so no two lists of parts are the same bytes."""
    return F.sha2(F.concat(*[F.concat(uvarint(F.octet_length(p)), F.encode(p, "utf-8")) for p in parts]), 256)


def schema_after(statements: DataFrame) -> DataFrame:
    """(table, column, type, file): columns as a run of DDL statements leaves them, names in lower case.

    statements: file, stmt, kind (create_table, alter_table, drop_table), table, column, type, dropped (boolean); a row per column,
    column null for drop_table. Files and statements are in order; the last writer of a column wins, what drops it or its table ends it.
    """
    rows = statements.select(F.lower("table").alias("table"), F.lower("column").alias("column"), "type", "file", "kind", "dropped", F.struct("file", "stmt").alias("at"))
    gone = rows.filter("kind = 'drop_table'").groupBy("table").agg(F.max("at").alias("gone"))
    last = rows.filter("column is not null").groupBy("table", "column").agg(F.max_by(F.struct("type", "file", "dropped"), F.struct("at", "dropped")).alias("c"), F.max("at").alias("at"))
    return last.join(gone, "table", "left").filter("not c.dropped and (gone is null or at > gone)").select("table", "column", "c.type", "c.file")


def changed_signatures(before: DataFrame, after: DataFrame, symmetric: bool = False) -> DataFrame:
    """Names (name) whose signature is another or gone in after (name, signature); with symmetric, those that are new too."""
    both = before.select("name", F.col("signature").alias("old")).join(after.select("name", F.col("signature").alias("new")), "name", "full" if symmetric else "left")
    return both.filter(~F.col("old").eqNullSafe(F.col("new"))).select("name")
