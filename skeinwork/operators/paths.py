"""Paths: what may be read, what is skipped, its language, and globs that say where a task may write."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Languages by file extension, then by whole file name, in lower case (fixed values).
LANGUAGES = {
    "go": "go", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "vue": "vue",
    "py": "python", "sql": "sql", "proto": "proto", "tf": "terraform", "hcl": "terraform", "yaml": "yaml", "yml": "yaml", "json": "json", "toml": "toml",
    "md": "markdown", "sh": "shell", "bash": "shell", "dockerfile": "dockerfile",
}
LANGUAGES_BY_NAME = {"dockerfile": "dockerfile", "makefile": "make", "go.mod": "gomod", "go.sum": "gomod"}
#: Folders that are not indexed unless the caller names others.
EXCLUDED = (".git", "node_modules", "vendor", "target", "dist")


def sensitive(path: Column) -> Column:
    """Whether a segment begins with .env, ends in .pem or .key or has credentials in it, or the path begins with .agent/secrets; in any case."""
    low = F.lower(path)
    return F.exists(F.split(low, "/"), lambda s: s.startswith(".env") | s.endswith(".pem") | s.endswith(".key") | s.contains("credentials")) | low.startswith(".agent/secrets")


def ignored(path: Column, excluded: tuple[str, ...] = EXCLUDED) -> Column:
    """Whether a file name is of what editors and tools drop, or a segment is an excluded folder."""
    name = F.substring_index(path, "/", -1)
    dropped = name.startswith(".#") | name.contains(".goutputstream")
    for end in ("~", ".swp", ".swx", ".tmp"):
        dropped = dropped | name.endswith(end)
    return dropped | F.exists(F.split(path, "/"), lambda s: s.isin(*excluded)) if excluded else dropped


def language(path: Column) -> Column:
    """Language by extension, in any case, else by the file's name; else empty."""
    name = F.lower(F.substring_index(path, "/", -1))
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    by_end = F.when(name.contains("."), F.element_at(table(LANGUAGES), F.substring_index(name, ".", -1)))
    return F.coalesce(by_end, F.element_at(table(LANGUAGES_BY_NAME), name), F.lit(""))


def prefixes(path: Column) -> Column:
    """The path and each directory above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def clean_path(path: Column) -> Column:
    """The path trimmed, without empty and `.` parts, and with `..` taken up; empty stays empty, `.` is what nothing is left of."""
    raw = F.trim(path)
    rooted = raw.startswith("/")
    parts = F.filter(F.split(raw, "/", -1), lambda p: (p != "") & (p != "."))
    up = lambda out, p: F.when((p == "..") & (F.size(out) > 0) & (F.coalesce(F.element_at(out, -1), F.lit("")) != ".."), F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).when((p == "..") & rooted, out).otherwise(F.concat(out, F.array(p)))
    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/")
    return F.when(raw == "", "").when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)


def glob_regex(pattern: str) -> str | None:
    """The regular expression of a glob, null where it is malformed.

    `*` is any run of signs but the slash, `?` one of them, `[a-c]` and `[^a-c]` one of a class, which is not empty; a backslash
    takes the next sign as it is. A range from a larger to a smaller sign is empty.
    """
    out, i, n = [], 0, len(pattern)
    sign = lambda c: f"\\x{{{ord(c):x}}}"

    def member() -> str | None:
        nonlocal i
        if i < n and pattern[i] == "\\":
            i += 1
        elif i < n and pattern[i] in "-]":
            return None
        if i >= n:
            return None
        i += 1
        return pattern[i - 1]

    while i < n:
        c = pattern[i]
        i += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            if i == n:
                return None
            out.append(sign(pattern[i]))
            i += 1
        elif c == "[":
            other = pattern[i : i + 1] == "^"
            i += other
            ranges, first = [], True
            while first or pattern[i : i + 1] != "]":
                first = False
                low = high = member()
                if low is not None and pattern[i : i + 1] == "-":
                    i += 1
                    high = member()
                if low is None or high is None:
                    return None
                if low <= high:
                    ranges.append(f"{sign(low)}-{sign(high)}")
            i += 1
            out.append(f"[{'^' if other else ''}{''.join(ranges)}]" if ranges else r"[\s\S]" if other else "(?!)")
        else:
            out.append(sign(c))
    return r"(?s)\A" + "".join(out) + r"\z"


@F.pandas_udf(StringType())
def _regexes(patterns: pd.Series) -> pd.Series:
    return patterns.map(lambda p: None if p is None else glob_regex(p))


def globs(patterns: DataFrame) -> DataFrame:
    """patterns (pattern) with head, the folder that whatever it matches lies in or is, and regex, null where it is malformed.

    head is what comes before the first segment with a sign of its own meaning: a key that patterns and paths meet by. Each
    pattern is compiled once.
    """
    parts = F.split(F.regexp_replace("pattern", r"/(\*\*)?$", ""), "/")
    plain = F.coalesce(F.array_position(F.transform(parts, lambda p: p.rlike(r"[*?\[\\]")), F.lit(True)).cast("int"), F.lit(0))
    head = F.array_join(F.when(plain == 0, parts).when(plain == 1, F.array().cast("array<string>")).otherwise(F.slice(parts, F.lit(1), F.greatest(plain - 1, F.lit(1)))), "/")
    return patterns.select("pattern").distinct().select("pattern", head.alias("head"), _regexes("pattern").alias("regex"))


def matches(paths: DataFrame, patterns: DataFrame) -> DataFrame:
    """Distinct (path, pattern) that match. `dir/**` is the folder and all below it; else the glob matches, or it names a folder above.

    A path is listed under itself, each folder above it and the root; a pattern under its head. So a path meets those patterns
    alone that name its folders. Malformed patterns match nothing.
    """
    tree = F.regexp_replace("pattern", r"/\*\*$", "")
    below = F.col("path").startswith(F.concat(tree, F.lit("/")))
    fits = F.when(F.col("pattern").endswith("/**"), (F.col("path") == tree) | below).otherwise(
        F.expr("path rlike regex") | F.col("path").startswith(F.concat(F.regexp_replace("pattern", "/$", ""), F.lit("/"))))
    listed = paths.select("path").distinct().select("path", F.explode(F.array_union(F.array(F.lit("")), prefixes(F.col("path")))).alias("head"))
    return listed.join(globs(patterns).filter("regex is not null"), "head").filter(fits).select("path", "pattern").distinct()


def bad_scopes(scopes: DataFrame) -> DataFrame:
    """(pattern, reason) of patterns that grant nothing: empty, absolute, with a backslash, leading out, or malformed."""
    checked = scopes.select("pattern").distinct().join(globs(scopes), "pattern", "left")
    outside = F.exists(F.split("pattern", "/"), lambda p: p == "..")
    why = F.when(F.coalesce("pattern", F.lit("")) == "", "empty").when(F.col("pattern").startswith("/"), "absolute").when(F.col("pattern").contains("\\"), "backslash").when(outside, "outside").when(F.col("regex").isNull(), "malformed")
    return checked.select("pattern", why.alias("reason")).filter("reason is not null")


def covered(changed: DataFrame, scopes: DataFrame) -> DataFrame:
    """Distinct (task, path) of changed files that a scope of the task covers. changed: task, path; scopes: task, pattern.

    A scope is cleaned first; `.` covers everything. Those of bad_scopes() cover nothing.
    """
    good = scopes.select("task", "pattern").distinct().join(bad_scopes(scopes).select("pattern"), "pattern", "left_anti").select("task", clean_path(F.col("pattern")).alias("pattern"))
    found = matches(changed, good.filter("pattern <> '.'"))
    some = changed.join(found, "path").join(good, ["task", "pattern"], "left_semi").select("task", "path")
    return some.union(changed.join(good.filter("pattern = '.'").select("task"), "task", "left_semi").select("task", "path")).distinct()


def out_of_scope(changed: DataFrame, scopes: DataFrame) -> DataFrame:
    """Distinct (task, path) of changed files that no scope of the task covers; a task without any scope has none."""
    scoped = changed.select("task", "path").distinct().join(scopes.select("task").distinct(), "task", "left_semi")
    return scoped.join(covered(scoped, scopes), ["task", "path"], "left_anti")


def bad_rules(rules: DataFrame) -> DataFrame:
    """(rule, fault) of rules (rule, pattern, reason) that a policy may not have: no_path, no_reason or malformed."""
    checked = rules.join(globs(rules.select("pattern")), "pattern", "left")
    fault = F.when(F.trim(F.coalesce("pattern", F.lit(""))) == "", "no_path").when(F.trim(F.coalesce("reason", F.lit(""))) == "", "no_reason").when(F.col("regex").isNull(), "malformed")
    return checked.select("rule", fault.alias("fault")).filter("fault is not null")


def violations(changed: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct (path, rule): changed paths, without a leading `./`, that a rule's pattern protects. rules: rule, pattern."""
    paths = changed.select(F.regexp_replace("path", r"^\./", "").alias("path"))
    return matches(paths, rules).join(rules.select("rule", "pattern"), "pattern").select("path", "rule").distinct()
