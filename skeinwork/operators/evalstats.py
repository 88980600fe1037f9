"""Small-sample statistics as column expressions and aggregates."""

from __future__ import annotations

import re
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Scratch

Z = 1.96


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """Bounds of the 95 % interval, within 0 and 1; both 0 where n is 0."""
    p = hits / n
    middle, scale = p + Z * Z / (2 * n), 1 + Z * Z / n
    reach = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    low, high = (F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / scale)) for x in (middle - reach, middle + reach))
    return F.when(n > 0, low).otherwise(0.0), F.when(n > 0, high).otherwise(0.0)


def rates(outcomes: DataFrame, *by: str) -> DataFrame:
    """Runs, solved ones, their rate and its bounds by the named columns."""
    out = outcomes.groupBy(*by).agg(F.count("*").alias("runs"), F.count_if("solved").alias("solved"))
    low, high = wilson(F.col("solved"), F.col("runs"))
    return out.select(*by, "runs", "solved", F.round(F.col("solved") / F.col("runs"), 8).alias("rate"), F.round(low, 8).alias("low"), F.round(high, 8).alias("high"))


def confusion(outcomes: DataFrame, *by: str) -> DataFrame:
    c, s = F.col("claimed"), F.col("solved")
    return outcomes.groupBy(*by).agg(F.count_if(c & s).alias("tp"), F.count_if(c & ~s).alias("fp"), F.count_if(~c & ~s).alias("tn"), F.count_if(~c & s).alias("fn"))


def mcnemar(pairs: DataFrame) -> DataFrame:
    """(won, lost, p): discordant pairs (base, variant: booleans) and the exact two-sided p."""
    n = pairs.agg(F.count_if(F.col("variant") & ~F.col("base")).alias("won"), F.count_if(F.col("base") & ~F.col("variant")).alias("lost"))
    return n.select("won", "lost", F.round(exact_p(F.col("won"), F.col("lost")), 8).alias("p"))


def positions(rows: DataFrame, *order: str) -> DataFrame:
    """rows with j, their place from 0 by the order columns, which are unique: dealt out by ranges, numbered in each, and moved on by what lies before.

    Only how many rows each range has is looked at together.
    """
    ranged = Scratch(rows.sparkSession, "positions").write(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_k", within).join(before, "_part").withColumn("j", (F.col("_k") + F.col("_before")).cast("long")).drop("_part", "_k", "_before")


def paired_bootstrap(deltas: DataFrame, pick: str, resamples: int = 10_000) -> DataFrame:
    """One row (pairs, mean, low, high): the mean delta and the bounds of its bootstrap; nulls where there is no pair, the mean where there is one.

    deltas: task_id, repetition, delta, one row a pair. `pick` is an expression over b (the resample), j (the draw) and n (the pairs)
    that gives the position drawn. Positions follow task_id and repetition. `resamples` bounds what is gathered for the bounds;
    draws are dealt out.
    """
    found = positions(deltas.filter("delta is not null").select("task_id", "repetition", "delta"), "task_id", "repetition")
    totals = found.agg(F.count("*").alias("pairs"), F.avg("delta").alias("mean"))
    placed = found.select("j", "delta").withColumn("n", totals.select("pairs").scalar())
    drawn = placed.select("j", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long"))).alias("b")).select("b", F.expr(pick).alias("k"))
    means = drawn.join(placed.select(F.col("j").alias("k"), "delta"), "k").groupBy("b").agg(F.avg("delta").alias("mean"))
    bounds = means.agg(F.sort_array(F.collect_list("mean")).alias("s"))
    low, high = int(0.025 * resamples) + 1, int(0.975 * resamples)
    pairs, mean = totals.select("pairs").scalar(), F.round(totals.select("mean").scalar(), 8)
    reach = lambda i: F.when(F.col("pairs") < 2, F.col("mean")).otherwise(F.round(F.get("s", F.lit(i - 1)), 8))
    return bounds.select(pairs.alias("pairs"), mean.alias("mean"), "s").select("pairs", "mean", reach(low).alias("low"), reach(high).alias("high"))


#: Verdicts on an interval, the width below which no difference is material, and what each verdict means for a component (fixed values).
POSITIVE, NEGATIVE, IMMATERIAL, INSUFFICIENT = "positive_evidence", "negative_evidence", "no_material_difference", "insufficient_evidence"
MATERIAL_WIDTH = 0.20
DECISIONS = {POSITIVE: "keep_enabled", NEGATIVE: "disable_by_default", IMMATERIAL: "insufficient_evidence", INSUFFICIENT: "insufficient_evidence"}

#: Statuses of runs that count as evidence (fixed values).
EVIDENCE_STATUSES = ("completed", "task_failed")


def evidence_run(status: Column, error: Column) -> Column:
    """Whether a run counts: by its status, or where it has none, by having no error."""
    return F.when(status.isNull(), error.isNull()).otherwise(status.isin(*EVIDENCE_STATUSES))


def interval_verdict(low: Column, high: Column) -> Column:
    return F.when(low > 0, POSITIVE).when(high < 0, NEGATIVE).when(high - low <= MATERIAL_WIDTH, IMMATERIAL).otherwise(INSUFFICIENT)


def order_statistic(rows: DataFrame, by: list[str], value: str, **positions: str) -> DataFrame:
    """(by, n, one column a position): values of each group at positions counted from 0 in ascending order.

    A position is an expression over n, the group's rows: `n div 2` is the upper median. Equal values are counted before they are
    ordered, so what is ordered is distinct values. Nulls are left out, and positions are held within 0 and n - 1.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    group = Window.partitionBy(*by)
    placed = counts.withColumn("upto", F.sum("c").over(group.orderBy(value))).withColumn("n", F.sum("c").over(group))
    at = lambda e: F.greatest(F.lit(0), F.least(F.expr(e).cast("long"), F.col("n") - 1))
    return placed.groupBy(*by).agg(F.first("n").alias("n"), *[F.min(F.when(F.col("upto") > at(e), F.col(value))).alias(name) for name, e in positions.items()])


_DRAW = "pmod(xxhash64(b, slot, side, i), {n})"
#: Draws that are counted in one row: few enough that the row's code is compiled as one method (fixed value).
_DRAWS = 8


def clustered_bootstrap(outcomes: DataFrame, pairs: DataFrame, resamples: int = 10_000, draw: str = _DRAW) -> DataFrame:
    """(baseline, variant, tasks, runs, delta, low, high, verdict) for every pair of arms.

    A resample draws tasks that both arms ran, then runs within each drawn task, for each arm on its own; its value is the mean
    over drawn tasks of the difference of solved rates. low and high are its values at round(p (resamples - 1)) for p = 0.025 and
    0.975, rounded to 8 digits before the verdict. A pair without a shared task has 0 tasks, null figures and no sufficient evidence.
    outcomes: arm, task_id, solved. `draw` is an expression over b (the resample), slot, side (0 the task, 1 and 2 the runs of
    baseline and variant), i (the run) and {n}, the number to draw from. A run's draw is a rank: those below the number of solved
    runs are solved, so runs are never gathered. Rows are pairs x tasks x resamples, joined on the drawn task. Draws are
    resamples x runs in number: resamples are dealt to all tasks, and a row counts _DRAWS of them as plain columns.
    """
    runs = outcomes.groupBy("arm", "task_id").agg(F.count("*").alias("n"), F.count_if("solved").alias("k"))
    base = runs.select(F.col("arm").alias("baseline"), "task_id", F.col("n").alias("nb"), F.col("k").alias("kb"))
    vary = runs.select(F.col("arm").alias("variant"), "task_id", F.col("n").alias("nv"), F.col("k").alias("kv"))
    cells = pairs.select("baseline", "variant").distinct().join(base, "baseline").join(vary, ["variant", "task_id"])
    pair = Window.partitionBy("baseline", "variant")
    cells = cells.withColumn("task", (F.row_number().over(pair.orderBy("task_id")) - 1).cast("long")).withColumn("tasks", F.count("*").over(pair))
    drawn = cells.select("baseline", "variant", F.col("task").alias("slot"), "tasks", F.lit(0).alias("side"), F.lit(0).cast("long").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long"))).alias("b"))
    drawn = drawn.select("baseline", "variant", "b", "slot", F.expr(draw.format(n="tasks")).alias("task")).join(cells.drop("tasks"), ["baseline", "variant", "task"])

    # dealt by number, as the rows are few and their draws many: by size they would be put into one task
    dealt = drawn.repartition(int(drawn.sparkSession.conf.get("spark.sql.shuffle.partitions")), "baseline", "variant", "b")
    side = lambda s, n, k: F.struct(F.lit(s).alias("side"), F.col(n).alias("n"), F.col(k).alias("k"))
    sides = dealt.select("baseline", "variant", "b", "slot", F.inline(F.array(side(1, "nb", "kb"), side(2, "nv", "kv"))))
    spans = sides.withColumn("i", F.explode(F.expr(f"sequence(0L, n - 1, {_DRAWS}L)")))
    hits = [F.expr(re.sub(r"\bi\b", f"(i + {j}L)", f"CASE WHEN i < n AND ({draw.format(n='n')}) < k THEN 1 ELSE 0 END")) for j in range(_DRAWS)]
    counted = spans.select("baseline", "variant", "b", "slot", "side", "n", reduce(add, hits).alias("hits"))
    of = lambda s: F.sum(F.when(F.col("side") == s, F.col("hits"))) / F.max(F.when(F.col("side") == s, F.col("n")))
    rates = counted.groupBy("baseline", "variant", "b", "slot").agg((of(2) - of(1)).alias("gain"))
    values = rates.groupBy("baseline", "variant", "b").agg(F.round(F.avg("gain"), 8).alias("value"))
    bounds = order_statistic(values, ["baseline", "variant"], "value", low="round(0.025 * (n - 1))", high="round(0.975 * (n - 1))").drop("n")
    whole = cells.groupBy("baseline", "variant").agg(F.count("*").alias("tasks"), F.sum(F.col("nb") + F.col("nv")).alias("runs"), F.round(F.avg(F.col("kv") / F.col("nv") - F.col("kb") / F.col("nb")), 8).alias("delta"))
    found = pairs.select("baseline", "variant").distinct().join(whole, ["baseline", "variant"], "left").join(bounds, ["baseline", "variant"], "left")
    return found.withColumn("tasks", F.coalesce("tasks", F.lit(0))).withColumn("runs", F.coalesce("runs", F.lit(0))).withColumn("verdict", interval_verdict(F.col("low"), F.col("high")))


def ladder(rungs: DataFrame, outcomes: DataFrame, resamples: int = 10_000, draw: str = _DRAW) -> DataFrame:
    """(letter, arm, over, delta, verdict, decision): each wired rung against the wired one below it, others with nulls.

    rungs: letter, arm, wired; letters order them. A pair is measured where both arms have runs.
    """
    below = Window.orderBy("letter").rowsBetween(Window.unboundedPreceding, -1)
    steps = rungs.withColumn("over", F.when(F.col("wired"), F.last(F.when(F.col("wired"), F.col("arm")), ignorenulls=True).over(below)))
    arms = outcomes.select("arm").distinct()
    pairs = steps.filter("over is not null").join(arms, "arm", "left_semi").join(arms.withColumnRenamed("arm", "over"), "over", "left_semi")
    measured = clustered_bootstrap(outcomes, pairs.select(F.col("over").alias("baseline"), F.col("arm").alias("variant")), resamples, draw)
    decision = F.coalesce(*[F.when(F.col("verdict") == v, d) for v, d in DECISIONS.items()])
    found = measured.select(F.col("variant").alias("arm"), F.col("baseline").alias("over"), "delta", "verdict", decision.alias("decision"))
    return steps.select("letter", "arm").join(found, "arm", "left").select("letter", "arm", "over", "delta", "verdict", "decision")


def exact_p(won: Column, lost: Column) -> Column:
    """The two-sided sign test: twice the chance of at most the smaller count among won + lost fair draws, 1 at most."""
    total, least = won + lost, F.least(won, lost)
    step = lambda s, i: F.struct((s["c"] + F.when(i == 0, 0.0).otherwise(F.log(total - i + 1) - F.log(i))).alias("c"), s["p"].alias("p"))
    tail = F.aggregate(
        F.sequence(F.lit(0).cast("long"), least), F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("p")),
        lambda s, i: F.struct(step(s, i)["c"].alias("c"), (s["p"] + F.exp(step(s, i)["c"] - total * F.log(F.lit(2.0)))).alias("p")),
    )["p"]
    return F.when(total == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def comparisons(outcomes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(baseline, variant, baseline_runs, variant_runs, delta, shared, won, lost, p, verdict) for every pair of arms.

    outcomes: arm, task_id, repetition, solved. Shared runs have task and repetition in common. verdict: not_run, no_shared_runs,
    better, worse (p under 0.05), agreed (no shared run differs) or no_difference.
    """
    rates_by = outcomes.groupBy("arm").agg(F.count("*").alias("n"), F.avg(F.col("solved").cast("int")).alias("r"))
    side = lambda arm, n, r: rates_by.select(F.col("arm").alias(arm), F.col("n").alias(n), F.col("r").alias(r))
    b = outcomes.select(F.col("arm").alias("baseline"), "task_id", "repetition", F.col("solved").alias("sb"))
    v = outcomes.select(F.col("arm").alias("variant"), "task_id", "repetition", F.col("solved").alias("sv"))
    asked = pairs.select("baseline", "variant").distinct()
    shared = asked.join(b, "baseline").join(v, ["variant", "task_id", "repetition"]).groupBy("baseline", "variant").agg(F.count("*").alias("shared"), F.count_if(F.col("sv") & ~F.col("sb")).alias("won"), F.count_if(F.col("sb") & ~F.col("sv")).alias("lost"))
    out = asked.join(side("baseline", "baseline_runs", "rb"), "baseline", "left").join(side("variant", "variant_runs", "rv"), "variant", "left").join(shared, ["baseline", "variant"], "left")
    out = out.fillna(0, ["baseline_runs", "variant_runs", "shared", "won", "lost"]).withColumn("delta", F.round(F.col("rv") - F.col("rb"), 8)).withColumn("p", F.round(exact_p(F.col("won"), F.col("lost")), 8))
    split, decided = F.col("won") + F.col("lost"), F.col("p") < 0.05
    verdict = F.when((F.col("baseline_runs") == 0) | (F.col("variant_runs") == 0), "not_run").when(F.col("shared") == 0, "no_shared_runs").when(decided & (F.col("delta") > 0), "better").when(decided & (F.col("delta") < 0), "worse").when(split == 0, "agreed").otherwise("no_difference")
    return out.select("baseline", "variant", "baseline_runs", "variant_runs", "delta", "shared", "won", "lost", "p", verdict.alias("verdict"))


#: What qualification asks for: held-out tasks, runs of each cell, arms with that many, rungs in a row (fixed values).
HELDOUT_TASKS, CELL_RUNS, FINALISTS, CHAIN = 30, 3, 2, 3


def qualification(facts: DataFrame) -> DataFrame:
    """(gate, met, observed) of the twelve gates, and a row 'all' that is met where every gate is; its observed lists the unmet.

    facts, one row: heldout_tasks, tasks, hidden_checks, min_repeats, finalists, runs, claims, chain, missing (count of absent
    environment fields), and the booleans baseline_comparison, graph_ablation, context_ablation, reproduced.
    """
    gates = {
        "heldout_real_tasks": ("heldout_tasks >= %d" % HELDOUT_TASKS, "heldout_tasks"),
        "finalist_repeats": (f"min_repeats >= {CELL_RUNS} and finalists >= {FINALISTS}", "concat(min_repeats, '/', finalists)"),
        "hidden_verification": ("tasks > 0 and hidden_checks = tasks", "concat(hidden_checks, '/', tasks)"),
        "baseline_comparison": ("baseline_comparison", "baseline_comparison"),
        "component_ladder": (f"chain >= {CHAIN}", "chain"),
        "graph_ablation": ("graph_ablation", "graph_ablation"),
        "context_ablation": ("context_ablation", "context_ablation"),
        "false_acceptance_measured": ("claims > 0", "claims"),
        "paired_statistics": ("runs > 0 and min_repeats > 0", "runs > 0 and min_repeats > 0"),
        "raw_results": ("runs > 0", "runs"),
        "environment_metadata": ("missing = 0", "missing"),
        "clean_reproduction": ("reproduced", "reproduced"),
    }
    cells = ", ".join(f"'{g}', coalesce({met}, false), cast({seen} as string)" for g, (met, seen) in gates.items())
    rows = facts.select(F.expr(f"stack({len(gates)}, {cells}) as (gate, met, observed)"))
    unmet = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("met"), F.col("gate")))), ",")
    return rows.unionByName(rows.agg(F.lit("all").alias("gate"), F.coalesce(F.bool_and("met"), F.lit(False)).alias("met"), unmet.alias("observed")))


def caveats(outcomes: DataFrame, tasks: DataFrame) -> DataFrame:
    """(subject, caveat, n): what weakens the numbers: unstable cells, a single pass, a small set, leaks, errors, false claims, tampering.

    outcomes: arm, task_id, repetition, solved, claimed, errored, tampered; tasks: task_id, leak_risk.
    """
    set_ = F.lit("set")
    cells = outcomes.groupBy("arm", "task_id").agg(F.countDistinct("solved").alias("v"), F.max("repetition").alias("passes"))
    spread = cells.agg(F.count_if(F.col("v") > 1).alias("unstable"), F.max("passes").alias("passes"))
    parts = [
        spread.filter("passes > 1 and unstable > 0").select(set_.alias("subject"), F.lit("unstable").alias("caveat"), F.col("unstable").alias("n")),
        spread.filter("passes = 1").select(set_, F.lit("single_pass"), F.lit(1).cast("long")),
        tasks.agg(F.count("*").alias("n")).filter("n < 30").select(set_, F.lit("small_set"), "n"),
        tasks.filter("leak_risk in ('public', 'unknown')").groupBy("leak_risk").agg(F.count("*").alias("n")).select(set_, F.concat(F.lit("leak_"), "leak_risk"), "n"),
    ]
    arms = outcomes.groupBy("arm").agg(F.count_if("errored").alias("errored"), F.count_if(F.expr("not errored and claimed and not solved")).alias("false_claims"), F.count_if(F.expr("not errored and tampered")).alias("tampered"))
    parts.append(arms.select("arm", F.expr("stack(3, 'errored', errored, 'false_claims', false_claims, 'tampered', tampered) as (caveat, n)")).filter("n > 0"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
