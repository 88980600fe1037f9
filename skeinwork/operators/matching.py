"""Joins on spans, prefixes and patterns, all turned into equal-key joins: nothing here compares every pair.

Each side that could be small is left to the adaptive planner, which broadcasts it only once its size is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .paths import prefixes


def innermost_span(points: DataFrame, spans: DataFrame, width: int = 64) -> DataFrame:
    """(point_id, span_id): the shortest span of the point's file that holds its line, the smallest span_id of equals.

    points: point_id, file_id, line, and target, a span that is not its own, if they have one. spans: span_id, file_id, first, last
    (inclusive). A span is listed under each block of `width` lines that it touches, so a point meets only spans of its own
    block. Points in no span have a null span_id, which stands for their file.
    """
    listed = spans.filter("first <= last").select("span_id", F.col("file_id").alias("f"), "first", "last", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))).alias("block"))
    inside = (F.col("file_id") == F.col("f")) & (F.floor(F.col("line") / width) == F.col("block")) & F.col("line").between(F.col("first"), F.col("last"))
    if "target" in points.columns:
        inside = inside & ~F.col("span_id").eqNullSafe(F.col("target"))
    best = F.min(F.when(F.col("span_id").isNotNull(), F.struct(F.col("last") - F.col("first"), "span_id")))
    return points.join(listed, inside, "left").groupBy("point_id").agg(best["span_id"].alias("span_id"))


def longest_prefix(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, root): the longest root that is the path or a directory above it; null where none is."""
    above = paths.select("path").distinct().select("path", F.explode(prefixes(F.col("path"))).alias("prefix"))
    found = above.join(roots.select("root").distinct(), F.col("prefix") == F.col("root"), "left")
    return found.groupBy("path").agg(F.max_by("root", F.when(F.col("root").isNotNull(), F.length("root"))).alias("root"))


def under(paths: DataFrame, directories: DataFrame) -> DataFrame:
    """Paths that are one of the directories or lie under one, once each. directories: root."""
    above = paths.select("path").distinct().select("path", F.explode(prefixes(F.col("path"))).alias("prefix"))
    return above.join(directories.select("root"), F.col("prefix") == F.col("root"), "left_semi").select("path").distinct()


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, lane, rule_order, allow): the first rule of the lane whose pattern is the host, or `*.` and a proper suffix of it; else nulls and false.

    hosts: host, lane; rules: rule_order, pattern, lanes (array; null or empty: all), allow. Case, space around and one point at the end
    of a host do not count. `*.example.org` does not match example.org itself.
    """
    bare = F.regexp_replace(F.lower(F.trim("host")), r"\.$", "")
    parts = F.split(bare, r"\.")
    wild = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.concat(F.lit("*."), F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    keys = F.concat(F.array(bare), F.when(F.size(parts) > 1, wild).otherwise(F.array().cast("array<string>")))
    wanted = rules.select("rule_order", F.lower(F.trim("pattern")).alias("pattern"), "lanes", "allow")
    fits = (F.col("key") == F.col("pattern")) & (F.coalesce(F.size("lanes"), F.lit(0)).isin(-1, 0) | F.array_contains("lanes", F.col("lane")))
    found = hosts.select("host", "lane").distinct().select("host", "lane", F.explode(keys).alias("key")).join(wanted, fits, "left")
    first = F.min(F.when(F.col("rule_order").isNotNull(), F.struct("rule_order", "allow")))
    return found.groupBy("host", "lane").agg(first.alias("m")).select("host", "lane", "m.rule_order", F.coalesce("m.allow", F.lit(False)).alias("allow"))


def routes(calls: DataFrame, patterns: DataFrame) -> DataFrame:
    """(call_id, route_id): each call with every route of a fitting method and pattern.

    calls: call_id, method, path. patterns: route_id, method ('' fits any), pattern. A pattern's segment `{name}` fits any
    segment, and a last segment `*` any rest, of one segment at least. Calls and patterns meet by their number of segments.
    """
    want = F.split("pattern", "/")
    open_end = F.element_at(want, -1) == "*"
    fixed = F.when(open_end, F.slice(want, F.lit(1), F.size(want) - 1)).otherwise(want)
    listed = patterns.select("route_id", F.col("method").alias("m"), open_end.alias("open_end"), fixed.alias("want")).withColumn("n", F.size("want"))
    got = F.split("path", "/")
    ways = F.concat(
        F.array(F.struct(F.lit(False).alias("open"), F.size(got).alias("k"))),
        F.when(F.size(got) > 1, F.transform(F.sequence(F.lit(1), F.size(got) - 1), lambda i: F.struct(F.lit(True).alias("open"), i.alias("k")))).otherwise(F.array().cast("array<struct<open:boolean,k:int>>")),
    )
    asked = calls.select("call_id", "method", got.alias("got"), F.explode(ways).alias("w"))
    fits = F.forall(F.zip_with(F.slice("got", F.lit(1), F.col("n")), "want", lambda g, w: (g == w) | w.rlike(r"^\{.*\}$")), lambda x: x)
    met = asked.join(listed, (F.col("w.open") == F.col("open_end")) & (F.col("w.k") == F.col("n")))
    return met.filter(((F.col("m") == "") | (F.col("m") == F.col("method"))) & fits).select("call_id", "route_id").distinct()


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) of paths created, changed or removed between two snapshots (path, digest, and mode if both have it); nulls equal each other."""
    kept = ["digest", *(["mode"] if "mode" in before.columns and "mode" in after.columns else [])]
    b, a = (df.select(F.col("path").alias(f"{x}p"), F.struct(*kept).alias(f"{x}d")) for df, x in ((before, "b"), (after, "a")))
    change = F.when(F.col("bp").isNull(), "created").when(F.col("ap").isNull(), "removed").when(~F.col("bd").eqNullSafe(F.col("ad")), "changed")
    return b.join(a, F.col("bp") == F.col("ap"), "full").select(F.coalesce("bp", "ap").alias("path"), change.alias("change")).filter("change is not null")


def narrow_commits(touched: DataFrame, indexed: DataFrame, most: int = 40) -> DataFrame:
    """(commit_id, path) of indexed paths, for commits that touch `most` files at most, indexed or not."""
    every = touched.select("commit_id", "path").distinct()
    few = every.groupBy("commit_id").agg(F.count("*").alias("n")).filter(F.col("n") <= most)
    return every.join(few.select("commit_id"), "commit_id", "left_semi").join(indexed.select("path"), "path", "left_semi").select("commit_id", "path")


def covered_lines(spans: DataFrame, length: DataFrame, margin: int = 3) -> DataFrame:
    """(file_id, first, last): spans widened by `margin` lines, cut to the file's lines and merged where they meet.

    spans: file_id, first, last. length: file_id, n_lines.
    """
    from pyspark.sql import Window

    wide = spans.join(length, "file_id").select("file_id", F.greatest(F.lit(1), F.col("first") - margin).alias("first"), F.least(F.col("n_lines"), F.col("last") + margin).alias("last")).filter("first <= last")
    order = Window.partitionBy("file_id").orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = wide.withColumn("opens", F.when(reach.isNull() | (F.col("first") > reach + 1), 1).otherwise(0))
    return opens.withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("file_id", "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")


#: What stands for lines that are not shown.
LEFT_OUT = "[lines left out]"


def shown_lines(files: DataFrame, spans: DataFrame, margin: int = 3, first: int = 80) -> DataFrame:
    """(file_id, body): the lines about a file's spans, each after its number, with LEFT_OUT where some are not shown; without any span the first ones.

    files: file_id, text; spans: file_id, first, last; one that begins before line 1 or ends before it begins is none.
    """
    lines = files.select("file_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    length = lines.select("file_id", F.size("lines").alias("n_lines"))
    good = spans.filter("first >= 1 and last >= first")
    merged = covered_lines(good.join(length.select("file_id"), "file_id", "left_semi"), length, margin)
    ranges = merged.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct(F.col("first").cast("int").alias("a"), F.col("last").cast("int").alias("b")))).alias("r"))
    asked = good.select("file_id").distinct().withColumn("asked", F.lit(True))
    whole = F.array(F.struct(F.lit(1).alias("a"), F.least(F.lit(first), F.size("lines")).alias("b")))
    none = F.array().cast("array<struct<a:int,b:int>>")
    rows = lines.join(ranges, "file_id", "left").join(asked, "file_id", "left").withColumn("r", F.coalesce("r", F.when(F.col("asked"), none).otherwise(whole)))
    numbered = lambda x: F.transform(F.slice("lines", x["a"], x["b"] - x["a"] + 1), lambda t, i: F.concat((i + x["a"]).cast("string"), F.lit(": "), t))
    parts = F.transform("r", lambda x, i: F.concat(F.when((i > 0) | (x["a"] > 1), F.array(F.lit(LEFT_OUT))).otherwise(F.array().cast("array<string>")), numbered(x)))
    end = F.coalesce(F.array_max(F.transform("r", lambda x: x["b"])), F.lit(0))
    tail = F.when(end < F.size("lines"), F.array(F.lit(LEFT_OUT))).otherwise(F.array().cast("array<string>"))
    return rows.select("file_id", F.array_join(F.concat(F.flatten(parts), tail), "\n").alias("body"))
