"""Result files of evaluation runs, and everything that is derived from the runs in them anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .evalstats import wilson

#: The newest version of result files that is known; files without one are older (fixed value).
VERSION = 2
#: Statuses of a run, the first two of which are evidence (fixed values).
STATUSES = ("completed", "task_failed", "environment_failed", "timeout", "invalid", "cancelled")
#: A run as a file holds it; what else is in a file, stored aggregates among it, is not read.
RUN = "run_id string, task_id string, category string, arm string, leak_risk string, set string, synthetic boolean, status string, solved boolean, claimed boolean, tampered boolean, repetition int, attempts int, duration long, tokens_used long, diff_bytes long, reasons array<string>, grade struct<total:int,failed:array<string>,ran:boolean>, error string"


def load_results(spark: SparkSession, paths: list[str], lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(runs, rejects): the runs of all files with the file each is from, and (file, reason) of files that are not read.

    A file is one JSON object with its version and its outcomes, or one on each line. Of a newer version it is rejected as `newer`, as
    its fields may mean something else; one that is no such object is `malformed`. A run's fields that are missing are null.
    """
    schema = f"benchmark_schema_version int, outcomes array<struct<{RUN.replace(' ', ':').replace(',:', ', ')}>>, _bad string"
    reader = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_bad").option("multiLine", not lines)
    rows = reader.json(paths).select("*", F.col("_metadata.file_path").alias("file"))
    reason = F.when(F.col("_bad").isNotNull(), "malformed").when(F.col("benchmark_schema_version") > VERSION, "newer")
    rows = rows.withColumn("reason", reason)
    runs = rows.filter("reason is null").select("file", F.explode("outcomes").alias("o")).select("file", "o.*")
    return runs, rows.filter("reason is not null").select("file", "reason").distinct()


def save_results(runs: DataFrame, folder: str) -> None:
    """Write runs as JSON lines of this version, a line a run, which load_results() reads with lines."""
    known = [c.strip().split()[0] for c in RUN.replace("struct<total:int,failed:array<string>,ran:boolean>", "struct").split(", ")]
    run = F.struct(*[c for c in known if c in runs.columns])
    runs.select(F.lit(VERSION).alias("benchmark_schema_version"), F.array(run).alias("outcomes")).write.json(folder)


def errored() -> Column:
    """Whether the run itself failed, as opposed to its task."""
    return F.coalesce("error", F.lit("")) != ""


def evidence() -> Column:
    """Whether a run counts in a rate: by its status, or, where it has none, if it did not err."""
    return F.when(F.coalesce("status", F.lit("")) == "", ~errored()).otherwise(F.col("status").isin(*STATUSES[:2]))


def classified() -> Column:
    """A run's status, worked out where it has none."""
    return F.when(F.coalesce("status", F.lit("")) != "", F.col("status")).when(errored(), STATUSES[2]).when(F.col("solved"), STATUSES[0]).otherwise(STATUSES[1])


def _rate(name: str, hits: Column, n: Column) -> list[Column]:
    low, high = wilson(hits, n)
    return [hits.alias(name), F.when(n > 0, F.round(hits / n, 8)).otherwise(0.0).alias(f"{name}_rate"), F.round(low, 8).alias(f"{name}_low"), F.round(high, 8).alias(f"{name}_high")]


def arm_summary(runs: DataFrame) -> DataFrame:
    """Rates with their bounds by arm, and by arm and category (null: all): runs that erred are counted and left out of the rest.

    (arm, category, runs, errored, tokens, then count, rate, low and high of solved, false_accept, missed and tampered).
    """
    ok, s, c = ~errored(), F.col("solved"), F.col("claimed")
    two = runs.rollup("arm", "category").agg(
        F.grouping_id().alias("level"), F.count_if(ok).alias("runs"), F.count_if(~ok).alias("errored"), F.sum(F.when(ok, F.coalesce("tokens_used", F.lit(0))).otherwise(0)).alias("tokens"),
        F.count_if(ok & s).alias("s"), F.count_if(ok & c & ~s).alias("f"), F.count_if(ok & ~c & s).alias("m"), F.count_if(ok & F.coalesce("tampered", F.lit(False))).alias("t"),
    ).filter("level < 3")
    rates = [x for name, hits in (("solved", "s"), ("false_accept", "f"), ("missed", "m"), ("tampered", "t")) for x in _rate(name, F.col(hits), F.col("runs"))]
    return two.select("arm", "category", "runs", "errored", "tokens", *rates)


def acceptance_rates(runs: DataFrame) -> DataFrame:
    """(arm, tp, fp, tn, fn, then count, rate, low and high of false acceptance among claims, among all, and of false rejection) over evidence."""
    c, s = F.col("claimed"), F.col("solved")
    n = runs.filter(evidence()).groupBy("arm").agg(F.count_if(c & s).alias("tp"), F.count_if(c & ~s).alias("fp"), F.count_if(~c & ~s).alias("tn"), F.count_if(~c & s).alias("fn"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return n.select("arm", "tp", "fp", "tn", "fn", *_rate("accepted_wrongly", fp, tp + fp), *_rate("wrong_share", fp, tp + fp + tn + fn), *_rate("rejected_wrongly", fn, tn + fn))


def status_counts(runs: DataFrame) -> DataFrame:
    """(arm, status, n) by classified status."""
    return runs.groupBy("arm", classified().alias("status")).agg(F.count("*").alias("n"))


def pairs(runs: DataFrame, base: str, variant: str, value: Column, order: str) -> DataFrame:
    """(task_id, repetition, base, variant): value of two arms where both have a run of the task and repetition that did not err.

    Of several such runs of an arm the last by `order` counts; a null value is no run.
    """
    rows = runs.filter(F.col("arm").isin(base, variant) & ~errored()).select("task_id", "repetition", "arm", F.col(order).alias("at"), value.alias("value")).filter("value is not null")
    last = lambda arm: F.max_by(F.when(F.col("arm") == arm, F.col("value")), F.when(F.col("arm") == arm, F.col("at")))
    both = rows.groupBy("task_id", "repetition").agg(last(base).alias("base"), last(variant).alias("variant"))
    return both.filter("base is not null and variant is not null")


#: Phases of a task, and those that may follow each (fixed values).
PHASES = ("INTAKE", "LOCALIZE", "IMPACT", "PLANNING", "EDIT", "VERIFY", "REVIEW", "FINALIZE")
TRANSITIONS = {
    "INTAKE": ("LOCALIZE",), "LOCALIZE": ("IMPACT",), "IMPACT": ("PLANNING",), "PLANNING": ("EDIT",), "EDIT": ("VERIFY", "PLANNING", "LOCALIZE"),
    "VERIFY": ("EDIT", "REVIEW", "LOCALIZE", "PLANNING"), "REVIEW": ("EDIT", "LOCALIZE", "FINALIZE"), "FINALIZE": (),
}


def phase_faults(journal: DataFrame) -> DataFrame:
    """(task, seq, before, phase) of steps that may not follow; a journal begins with the first phase, and staying in one is no step.

    journal: task, seq, phase.
    """
    before = F.lag("phase").over(Window.partitionBy("task").orderBy("seq"))
    allowed = F.coalesce(*[F.when(F.col("before") == p, F.col("phase").isin(*after) if after else F.lit(False)) for p, after in TRANSITIONS.items()], F.lit(False))
    steps = journal.select("task", "seq", before.alias("before"), "phase")
    return steps.filter(~F.when(F.col("before").isNull(), F.col("phase") == PHASES[0]).otherwise((F.col("before") == F.col("phase")) | allowed))


#: What a captured output ends with when it was cut (fixed value).
CUT_OUTPUT = "… (output truncated)"


def hidden_tests(tasks: DataFrame) -> DataFrame:
    """(task_id, tests): the distinct tests that a task's hidden files (task_id, text) declare: functions at a line's start named Test and more."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.startswith("func Test") & x.contains("("))
    names = F.transform(lines, lambda x: F.rtrim(F.substring_index(F.substring(x, F.lit(6), F.length(x)), "(", 1)))
    good = F.filter(names, lambda n: n.rlike("^[A-Za-z0-9_]+$"))
    found = tasks.select("task_id", F.explode(good).alias("name"))
    return found.groupBy("task_id").agg(F.array_sort(F.collect_set("name")).alias("tests"))


def graded_runs(runs: DataFrame, tests: DataFrame) -> DataFrame:
    """(run_id, task_id, arm, total, failed, passed, score) of the runs that can be graded by what their task's tests left in their output.

    runs: run_id, task_id, arm, solved, error, output, recorded; tests from hidden_tests(). Left out are runs graded before, ones that
    erred, ones whose output was cut, as a failure may be lost, and tasks without tests. A solved run passes all; one that is not
    passes those it does not name as failed, and none if it names none, as it did not get as far as a test.
    """
    open_runs = runs.filter(~errored() & ~F.coalesce("recorded", F.lit(False)) & ~F.contains(F.coalesce("output", F.lit("")), F.lit(CUT_OUTPUT)))
    mark = "--- FAIL: "
    lines = F.filter(F.transform(F.split(F.coalesce("output", F.lit("")), "\n", -1), lambda x: F.ltrim(x)), lambda x: x.startswith(mark + "Test"))
    named = F.transform(lines, lambda x: F.regexp_extract(F.substring(x, F.lit(len(mark) + 1), F.length(x)), "^[A-Za-z0-9_]+", 0))
    rows = open_runs.join(tests, "task_id").withColumn("total", F.size("tests"))
    failed = F.when(F.col("solved"), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_intersect("tests", named)))
    passed = F.when(F.col("solved"), F.col("total")).when(F.size("failed") == 0, 0).otherwise(F.col("total") - F.size("failed"))
    return rows.withColumn("failed", failed).withColumn("passed", passed).select("run_id", "task_id", "arm", "total", "failed", "passed", (F.col("passed") / F.col("total")).alias("score"))


def rate_text(hits: Column, n: Column) -> Column:
    """A rate as a report says it, `33% (1/3) [6–79%]`, halves to the even side; a dash where there is nothing to count."""
    low, high = wilson(hits, n)
    whole = lambda x: F.bround(x * 100.0, 0).cast("long").cast("string")
    return F.when(n > 0, F.concat(whole(hits / n), F.lit("% ("), hits, F.lit("/"), n, F.lit(") ["), whole(low), F.lit("–"), whole(high), F.lit("%]"))).otherwise("—")


def markdown(table: DataFrame, order: list[str], limit: int = 1000) -> str:
    """The first `limit` rows as a Markdown table, columns and rows in order: a report of aggregates, which is formatted on the driver."""
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    rows = table.orderBy(*order).limit(limit).collect()
    lines = [table.columns, ["---"] * len(table.columns), *rows]
    return "".join("| " + " | ".join(cell(x) for x in line) + " |\n" for line in lines)


def cut_text(text: Column, width: int) -> Column:
    """The text without space around, on one line, and cut with a mark after `width` signs."""
    line = F.replace(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit("\n"), F.lit(" "))
    return F.when(F.length(line) <= width, line).otherwise(F.concat(F.substring(line, 1, width), F.lit("…")))


def json_summary(text: Column) -> Column:
    """One line of a JSON object: its keys in order as `k=v`, lists as `k[n]`, objects as `k{…}`; other text is shown as it is, cut.

    Empty text and null give an empty line.
    """
    fields = F.from_json(text, "map<string,variant>")
    one = lambda k: (lambda v, kind: F.when(v.isNull() | (kind == "VOID"), F.concat(k, F.lit("=null"))).when(kind.startswith("ARRAY"), F.concat(k, F.lit("["), F.size(v.cast("array<variant>")).cast("string"), F.lit("]"))).when(kind.startswith("OBJECT"), F.concat(k, F.lit("{…}"))).when(kind == "STRING", F.concat(k, F.lit("="), cut_text(v.cast("string"), 60))).otherwise(F.concat(k, F.lit("="), v.cast("string"))))(F.element_at(fields, k), F.schema_of_variant(F.element_at(fields, k)))
    line = cut_text(F.array_join(F.transform(F.array_sort(F.map_keys(fields)), one), "  "), 200)
    return F.when(text.isNull() | F.trim(text).isin("", "null"), "").when(fields.isNull() | ~F.trim(text).startswith("{"), cut_text(text, 120)).otherwise(line)
