"""Failures of checks: their text without what changes from run to run, their class, and findings in the logs of tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Units of the durations that a failure's text is cleaned of (fixed values).
UNITS = ("ms", "µs", "ns", "s")
#: Signs, in lower-case text, that the surroundings failed and not the code (fixed values).
SURROUNDINGS = (
    "no space left", "network unreachable", "network is unreachable", "address already in use",
    "module lookup disabled", "module not found in cache", "executable file not found", "permission denied",
)
#: Classes; of those that hold, the last counts (fixed values).
CLASSES = ("NEW", "REGRESSION", "SAME", "ENVIRONMENTAL")
_VOLATILE = "<volatile>"


def normalised(text: Column, root: str = "") -> Column:
    """The text without what changes from run to run, and with every run of space as one.

    The root folder goes from before paths; then addresses in hex, durations, dates with a time, goroutine numbers and the first
    folder under /tmp become <volatile>, in this order. A number that is part of a longer word is none.
    """
    apart, ends = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
    digits = "[0-9]"
    clock = f"{digits}{{4}}-{digits}{{2}}-{digits}{{2}}[T ][-+:.0-9Z]+"
    if root:
        text = F.replace(text, F.lit(f"{root}/"), F.lit(""))
    for found in ("0x[0-9A-Fa-f]+", f"{apart}{digits}+([.]{digits}+)?({'|'.join(UNITS)}){ends}", apart + clock, f"goroutine {digits}+", r"/tmp/[^\s/]+"):
        text = F.regexp_replace(text, found, _VOLATILE)
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def fingerprint(recipe: Column, status: Column, exit_code: Column, headline: Column, error: Column, findings: Column, symbols: Column, root: str = "") -> Column:
    """sha256 of what identifies a failure: findings (array of file, line, col, message) normalised and in order, symbols as a sorted set."""
    clean = F.transform(findings, lambda f: F.struct(normalised(f["file"], root).alias("file"), f["line"].alias("line"), f["col"].alias("col"), normalised(f["message"], root).alias("message")))
    parts = F.struct(
        recipe.alias("recipe"), status.alias("status"), exit_code.alias("exit"), normalised(headline, root).alias("headline"), normalised(error, root).alias("error"),
        F.array_sort(clean).alias("findings"), F.array_sort(F.array_distinct(symbols)).alias("symbols"),
    )
    return F.sha2(F.to_json(parts), 256)


def environmental(status: Column, *texts: Column) -> Column:
    """Whether the surroundings failed: a sign in the texts, in any case, or a check that could not run at all (status error)."""
    low = F.lower(F.concat_ws(" ", *texts))
    found = status == "error"
    for sign in SURROUNDINGS:
        found = found | low.contains(sign)
    return F.coalesce(found, F.lit(False))


def regressions(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """Distinct (recipe, test) that fail now where the same test, or its recipe as a whole, passes in the baseline.

    now, baseline: recipe, test, passed; a null test stands for the recipe as a whole, and one that fails is compared with that.
    """
    failed = now.filter("not passed").select("recipe", "test").distinct()
    whole = baseline.filter("passed and test is null").select("recipe").distinct()
    one = baseline.filter("passed and test is not null").select("recipe", "test").distinct()
    return failed.join(one, ["recipe", "test"], "left_semi").union(failed.join(whole, "recipe", "left_semi").select("recipe", "test")).distinct()


def failure_class(failures: DataFrame, baseline: DataFrame, root: str = "") -> DataFrame:
    """(failure_id, print, class): the last of CLASSES that holds.

    failures: failure_id (in order), recipe, status, exit_code, headline, error, findings, symbols, failed (array of failing tests).
    baseline: recipe, test (null: the recipe as a whole), passed. REGRESSION needs the status fail and a failing test, or the whole
    recipe, that passes in the baseline; SAME a print that came before; ENVIRONMENTAL see environmental().
    """
    messages = F.array_join(F.transform("findings", lambda f: f["message"]), " ")
    rows = failures.select(
        "failure_id", "recipe", "status", "failed", environmental(F.col("status"), F.col("error"), F.col("headline"), messages).alias("around"),
        fingerprint(*[F.col(c) for c in ("recipe", "status", "exit_code", "headline", "error", "findings", "symbols")], root).alias("print"),
    )
    fails = rows.filter("status = 'fail'")
    named = fails.select("failure_id", "recipe", F.explode("failed").alias("test"))
    tests = named.join(baseline.filter("passed and test is not null").select("recipe", "test").distinct(), ["recipe", "test"], "left_semi").select("failure_id")
    whole = fails.join(baseline.filter("passed and test is null").select("recipe").distinct(), "recipe", "left_semi").select("failure_id")
    worse = tests.union(whole).distinct().withColumn("worse", F.lit(True))
    first = rows.groupBy("print").agg(F.min("failure_id").alias("first"))
    new, regression, same, outside = CLASSES
    verdict = F.when(F.col("around"), outside).when(F.col("failure_id") > F.col("first"), same).when(F.col("worse"), regression).otherwise(new)
    return rows.join(worse, "failure_id", "left").join(first, "print").select("failure_id", "print", verdict.alias("class"))


#: Verbs that SQL begins with, and words that a table's name follows (fixed values).
SQL_VERBS = ("SELECT", "INSERT", "UPDATE", "DELETE", "WITH")
BEFORE_TABLES = ("FROM", "JOIN", "INTO", "UPDATE")


def _without_comments(text: Column) -> Column:
    """SQL without comments; strings go too where they are not needed, as they may hold the words of a statement."""
    return F.regexp_replace(text, r"--[^\n]*|/\*(?s:.*?)(\*/|$)", " ")


def sql_verb(text: Column) -> Column:
    """The verb that the text begins with after comments and space, upper case; null where it does not look like SQL."""
    words = F.split(F.ltrim(F.regexp_replace(_without_comments(text), r"\s", " ")), " ", 2)
    first = F.upper(F.get(words, F.lit(0)))
    return F.when((F.size(words) == 2) & first.isin(*SQL_VERBS), first)


def sql_tables(text: Column) -> Column:
    """Distinct names after FROM, JOIN, INTO and UPDATE, sorted; empty where the text does not look like SQL.

    The statement is cut in words, signs and strings; a name is a word or two with a point between, so what strings and comments say
    names no table.
    """
    token = r"'(?:[^']|'')*'|[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)?|[^\s]"
    words = F.regexp_extract_all(_without_comments(text), F.lit(token), F.lit(0))
    after = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.when(F.upper(a).isin(*BEFORE_TABLES) & b.rlike("^[A-Za-z_]"), b))
    return F.when(sql_verb(text).isNotNull(), F.array_sort(F.array_distinct(F.filter(after, lambda x: x.isNotNull())))).otherwise(F.array().cast("array<string>"))


def _place(text: Column) -> tuple[Column, Column, Column, Column]:
    """(file, line, column, rest) of `file.go:line:rest` or `file.go:line:column: rest`; nulls where the text does not begin so."""
    parts = F.split(text, ":", -1)
    file = F.get(parts, F.lit(0))
    whole = lambda p: F.when(p.rlike("^[0-9]+$"), p.cast("long"))
    line, col = whole(F.get(parts, F.lit(1))), whole(F.get(parts, F.lit(2)))
    rest = F.array_join(F.slice(parts, F.when(col.isNotNull() & (F.size(parts) > 3), 4).otherwise(3), F.size(parts)), ":")
    holds = file.endswith(".go") & ~file.contains(" ") & ~file.contains("\t") & (F.length(file) > 3) & line.isNotNull() & (F.size(parts) > 2)
    col = F.when(F.size(parts) > 3, col)
    return tuple(F.when(holds, x) for x in (file, line, F.coalesce(col, F.lit(0)), rest))


def diagnostics(lines: DataFrame) -> DataFrame:
    """(log, file, line, col, message): distinct compiler findings of lines (log, line_no, text); col is 0 where it has none."""
    file, line, col, rest = _place(F.trim("text"))
    found = lines.select("log", file.alias("file"), line.alias("line"), col.alias("col"), F.ltrim(rest).alias("message"), rest.alias("rest"))
    return found.filter("file is not null and rest rlike '^[ \\t]'").drop("rest").distinct()


def failed_tests(lines: DataFrame) -> DataFrame:
    """(log, test, file, line): every failed test of lines (log, line_no, text) with the first place named after it, null if none.

    A place is an indented `file.go:line:` and belongs to the failed test last named before it in the log. Lines that name neither are
    left out before a log is put in order, which is done in one task.
    """
    mark = "--- FAIL: "
    text = F.ltrim("text")
    test = F.when(text.startswith(mark), F.get(F.split(F.substring(text, len(mark) + 1, 10_000), r"\s"), F.lit(0)))
    file, line, _, _ = _place(text)
    indented = F.col("text").rlike(r"^\s")
    rows = lines.select("log", "line_no", test.alias("test"), F.when(indented, file).alias("file"), line.alias("line")).filter("test is not null or file is not null")
    order = Window.partitionBy("log").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    tagged = rows.withColumn("now", F.last(F.when(F.col("test").isNotNull(), F.struct("line_no", "test")), ignorenulls=True).over(order)).filter("now is not null")
    at = F.min(F.when(F.col("file").isNotNull(), F.struct("line_no", "file", "line")))
    return tagged.groupBy("log", "now").agg(at.alias("at")).select("log", "now.test", "at.file", "at.line")


def event_statuses(lines: DataFrame) -> DataFrame:
    """(log, test, status): the last pass, fail or skip of each test in JSON lines (log, line_no, text); other lines are left out."""
    e = F.from_json("text", "Action string, Package string, Test string")
    rows = lines.select("log", "line_no", e.alias("e")).filter("e.Test <> '' and e.Action in ('pass', 'fail', 'skip')")
    return rows.groupBy("log", F.concat("e.Package", F.lit("/"), "e.Test").alias("test")).agg(F.max_by("e.Action", "line_no").alias("status"))


def linter_findings(reports: DataFrame) -> DataFrame:
    """(report, linter, severity, file, line, col, message): distinct findings of a linter's JSON reports (report, text).

    A report is one object whose Issues name a place each; one that is no JSON, or has none, gives nothing.
    """
    schema = "Issues array<struct<FromLinter:string,Severity:string,Text:string,Pos:struct<Filename:string,Line:long,Column:long>>>"
    issues = reports.select("report", F.explode(F.from_json("text", schema)["Issues"]).alias("i"))
    return issues.select(
        "report", F.coalesce("i.FromLinter", F.lit("")).alias("linter"), F.coalesce("i.Severity", F.lit("")).alias("severity"), F.col("i.Pos.Filename").alias("file"),
        F.coalesce("i.Pos.Line", F.lit(0)).alias("line"), F.coalesce("i.Pos.Column", F.lit(0)).alias("col"), F.col("i.Text").alias("message"),
    ).distinct()


def crashes(lines: DataFrame) -> DataFrame:
    """(log, kind, n): how often each log (log, text) reports a data race or a panic."""
    kind = F.when(F.trim("text").startswith("WARNING: DATA RACE"), "race").when(F.ltrim("text").startswith("panic:"), "panic")
    return lines.select("log", kind.alias("kind")).filter("kind is not null").groupBy("log", "kind").agg(F.count("*").alias("n"))
