"""Folding logs to state: latest rows, carried values, streaks, verdicts over required kinds. Keys are grouped, never gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checks import uvarint

#: Results from best to worst (fixed values).
RESULT_RANK = ("pass", "skipped", "error", "fail")


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order columns, by one aggregate: a hot key is combined before it is shuffled."""
    rest = [c for c in rows.columns if c not in key]
    ranked = F.struct(*order, *[c for c in rest if c not in order])
    return rows.groupBy(*key).agg(F.max(ranked).alias("m")).select(*key, *[F.col("m")[c].alias(c) for c in rest])


def numbered(rows: DataFrame, key: str, order: list[str], before: DataFrame | None = None) -> DataFrame:
    """rows with seq: 1, 2, ... in each key, going on from the largest seq that `before` (key, seq) has for it."""
    out = rows.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))
    if before is None:
        return out
    last = before.groupBy(F.col(key).alias("k")).agg(F.max("seq").alias("last"))
    return out.join(last, F.col(key) == F.col("k"), "left").withColumn("seq", F.col("seq") + F.coalesce("last", F.lit(0))).drop("k", "last")


def carried(rows: DataFrame, key: str, order: list[str], value: Column, name: str) -> DataFrame:
    """rows with the last value that is not null before each row of the key."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(before))


def longest_run(rows: DataFrame, key: str, order: str, holds: Column) -> DataFrame:
    """(key, longest): the most consecutive rows of a key for which the condition holds; 0 where it never does."""
    w = Window.partitionBy(key).orderBy(order)
    runs = rows.select(key, order, holds.alias("holds")).withColumn("run", F.sum((~F.col("holds")).cast("int")).over(w))
    return runs.groupBy(key, "run").agg(F.count_if("holds").alias("n")).groupBy(key).agg(F.max("n").alias("longest"))


def consecutive_pairs(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Distinct (key, a, b) of neighbours in order; equal neighbours give none."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.select(key, F.lag(value).over(w).alias("a"), F.col(value).alias("b")).filter("a is not null and b is not null and a <> b").distinct()


def required_results(subjects: DataFrame, required: DataFrame, results: DataFrame) -> DataFrame:
    """(subject, kind, status): the worst result of each required kind, `missing` where there is none.

    subjects: subject. required: kind, a short list that every subject has. results: subject, kind, status of RESULT_RANK.
    """
    rank = F.array_position(F.array(*map(F.lit, RESULT_RANK)), F.col("status"))
    worst = results.groupBy("subject", "kind").agg(F.max(rank).alias("r"))
    kinds = required.agg(F.sort_array(F.collect_set("kind")).alias("kinds")).scalar()
    asked = subjects.select("subject").distinct().select("subject", F.explode(kinds).alias("kind"))
    return asked.join(worst, ["subject", "kind"], "left").select("subject", "kind", F.when(F.col("r").isNull(), "missing").otherwise(F.element_at(F.array(*map(F.lit, RESULT_RANK)), F.col("r").cast("int"))).alias("status"))


def passing_kinds(results: DataFrame) -> DataFrame:
    """(subject, passing): distinct kinds with a pass."""
    return results.groupBy("subject").agg(F.countDistinct(F.when(F.col("status") == "pass", F.col("kind"))).alias("passing"))


def flaky(first: DataFrame, again: DataFrame) -> DataFrame:
    """(run, test, class): failures of the first run; FLAKY where a re-run of the run has no failure at all, else FAILED.

    first, again: run, test, passed.
    """
    clean = again.groupBy("run").agg(F.count_if(~F.col("passed")).alias("bad")).filter("bad = 0").select(F.col("run").alias("clean"))
    return first.filter("not passed").join(clean, F.col("run") == F.col("clean"), "left").select("run", "test", F.when(F.col("clean").isNotNull(), "FLAKY").otherwise("FAILED").alias("class"))


def top_repeats(calls: DataFrame, most: int = 3) -> DataFrame:
    """(task, call, n, others): calls made more than once, the first `most` by n, then name; others is how many more there are."""
    counts = calls.groupBy("task", "call").agg(F.count("*").alias("n")).filter("n > 1")
    w = Window.partitionBy("task")
    ranked = counts.withColumn("k", F.row_number().over(w.orderBy(F.desc("n"), "call"))).withColumn("others", F.greatest(F.count("*").over(w) - most, F.lit(0)))
    return ranked.filter(F.col("k") <= most).select("task", "call", "n", "others")


def needle_cap(probes: DataFrame) -> DataFrame:
    """(model, size): the largest size up to which every conclusive probe was found. probes: model, size, found (null: not conclusive).

    Sizes without a conclusive probe neither count nor stop; a model that fails at its smallest size has a null one.
    """
    sizes = probes.filter("found is not null").groupBy("model", "size").agg(F.bool_and("found").alias("all_found"))
    fail = sizes.groupBy("model").agg(F.min(F.when(~F.col("all_found"), F.col("size"))).alias("first_fail"))
    return sizes.join(fail, "model").groupBy("model").agg(F.max(F.when(F.col("first_fail").isNull() | (F.col("size") < F.col("first_fail")), F.col("size"))).alias("size"))


def ranked_candidates(candidates: DataFrame) -> DataFrame:
    """Acceptable candidates with place and tie: least out of scope, most passing kinds, least diff bytes, then candidate.

    candidates: task, candidate, acceptable, out_of_scope, passing, diff_bytes. tie: the task's first two are equal on the first two keys.
    """
    w = Window.partitionBy("task").orderBy("out_of_scope", F.desc("passing"), "diff_bytes", "candidate")
    ranked = candidates.filter("acceptable").withColumn("place", F.row_number().over(w).cast("long"))
    first = ranked.filter("place <= 2").groupBy("task").agg(((F.count("*") == 2) & (F.min("out_of_scope") == F.max("out_of_scope")) & (F.min("passing") == F.max("passing"))).alias("tie"))
    return ranked.join(first, "task").select("task", "candidate", "place", "tie")


def replace_keys(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old without the keys that new has, and all of new: the same again changes nothing."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """One row a key, the new one where there is one; new has each key once."""
    return replace_keys(old, new, key)


def insert_missing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old, and those rows of new whose key old does not have; of new rows with one key the smallest counts."""
    rest = [c for c in new.columns if c not in key]
    once = new.groupBy(*key).agg(F.min(F.struct(*rest)).alias("m")).select(*key, *[F.col("m")[c].alias(c) for c in rest])
    return old.unionByName(once.join(old.select(*key), key, "left_anti"))


def manifest(files: DataFrame) -> DataFrame:
    """(tree, digest): SHA-256 over each tree's paths and hashes in order of path, each after its length in bytes. files: tree, path, hash.

    One digest of an ordered stream cannot be put together from parts. Trees are dealt to partitions and sorted there, with what
    does not fit on disk; a task holds one batch and the digest so far, however large a tree is. Null trees are left out.
    """
    import pandas as pd

    def run(batches):
        from hashlib import sha256

        tree, digest = None, None
        for batch in batches:
            for t, data in zip(batch["tree"], batch["data"]):
                if t != tree:
                    if tree is not None:
                        yield pd.DataFrame({"tree": [tree], "digest": [digest.hexdigest()]})
                    tree, digest = t, sha256()
                digest.update(data)
        if tree is not None:
            yield pd.DataFrame({"tree": [tree], "digest": [digest.hexdigest()]})

    data = F.concat(*[x for c in ("path", "hash") for x in (uvarint(F.octet_length(c)), F.encode(c, "utf-8"))])
    rows = files.filter("tree is not null").select(F.col("tree").cast("string").alias("tree"), "path", data.alias("data"))
    return rows.repartition("tree").sortWithinPartitions("tree", "path").select("tree", "data").mapInPandas(run, "tree string, digest string")


def graded(outcomes: DataFrame, tests: DataFrame) -> DataFrame:
    """outcomes with total, passed and score of their task's hidden tests (task_id, total, failed: named failures).

    A run that is not solved and has no named failure did not get as far as a test: it passes none. No tests give score 0.
    """
    passed = F.when(~F.col("solved") & (F.col("failed") == 0), 0).otherwise(F.col("total") - F.col("failed"))
    return outcomes.join(tests, "task_id").withColumn("passed", passed).withColumn("score", F.when(F.col("total") > 0, F.col("passed") / F.col("total")).otherwise(0.0))


def _one_of(value: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(value == w, i) for i, w in enumerate(words)], F.lit(len(words)))


def acceptance(subjects: DataFrame, required: DataFrame, results: DataFrame) -> DataFrame:
    """(subject, accepted, reasons): the contract over a subject's results; reasons are what speaks against it, sorted.

    subjects: subject, level, candidate, effect_expected, effect_made, out_of_scope (files outside the scope); required: level,
    kind; results: subject, kind, seq, status, candidate. Of several results of a kind the worst counts, the first of equal ones.
    A required kind must pass on the subject's candidate; another kind that failed on it disqualifies too. An empty candidate,
    of subject or result, matches any. Results are reduced to one a kind before anything is gathered.
    """
    worst = results.groupBy("subject", "kind").agg(F.max_by(F.struct("status", F.col("candidate").alias("on")), F.struct(_one_of(F.col("status"), RESULT_RANK), -F.col("seq"))).alias("r"))
    worst = worst.select("subject", "kind", "r.status", "r.on")
    asked = subjects.select("subject", "level", "candidate").join(required, "level").join(worst, ["subject", "kind"], "left")
    older = lambda: (F.col("candidate") != "") & (F.col("on") != "") & (F.col("on") != F.col("candidate"))
    why = F.when(F.col("status").isNull(), "missing").when(F.col("status") != "pass", F.col("status")).when(older(), "older")
    against = asked.select("subject", F.concat("kind", F.lit(":"), why).alias("reason"))
    others = worst.filter("status = 'fail'").join(subjects.select("subject", "level", "candidate"), "subject").join(required, ["level", "kind"], "left_anti").filter(~older())
    against = against.union(others.select("subject", F.concat("kind", F.lit(":fail"))))
    against = against.union(subjects.select("subject", F.when(F.expr("effect_expected and not effect_made"), "no_effect")))
    against = against.union(subjects.select("subject", F.when(F.col("out_of_scope") > 0, F.concat(F.lit("out_of_scope:"), "out_of_scope"))))
    reasons = against.groupBy("subject").agg(F.array_join(F.array_sort(F.collect_list("reason")), ",").alias("reasons"))
    return reasons.select("subject", (F.col("reasons") == "").alias("accepted"), "reasons")


def presets(subjects: DataFrame, frozen: DataFrame, results: DataFrame) -> DataFrame:
    """(subject, passed, missing): every frozen preset (subject, name) needs its last result to be a pass on the subject's candidate.

    subjects: subject, candidate; results: subject, name, seq, status, candidate. A subject without presets does not pass.
    """
    last = results.groupBy("subject", "name").agg(F.max_by(F.struct("status", "candidate"), "seq").alias("r")).select("subject", "name", "r.status", F.col("r.candidate").alias("on"))
    rows = subjects.join(frozen, "subject", "left").join(last, ["subject", "name"], "left")
    met = F.coalesce((F.col("status") == "pass") & (F.col("on") == F.col("candidate")), F.lit(False))
    return rows.groupBy("subject").agg(F.bool_and(met).alias("passed"), F.count_if(F.col("name").isNotNull() & ~met).alias("missing"))


#: What is wrong with a step, in the order it is looked for, and the levels there are (fixed values).
LEVELS = ("low", "standard", "high")


def plan_faults(steps: DataFrame, most: int = 8) -> DataFrame:
    """(plan, step, fault): the first fault of each plan that has one; step 0 stands for the plan.

    steps: plan, step (from 1, no gaps), title, scope (array), verification, depends_on (array). Dependencies must exist and come
    before the step, so a plan without a fault has no cycle.
    """
    n = F.count("*").over(Window.partitionBy("plan"))
    bad = lambda d: (d < 1) | (d >= F.col("step"))
    first = F.get(F.filter("depends_on", bad), F.lit(0))
    outside = F.exists("scope", lambda s: s.startswith("/") | s.contains(".."))
    fault = (
        F.when(F.trim("title") == "", "no_title").when(F.size("scope") == 0, "no_scope").when(outside, "scope_outside").when(~F.col("verification").isin(*LEVELS), "no_level")
        .when((first < 1) | (first > F.col("n")), "no_such_step").when(first.isNotNull(), "not_before")
    )
    rows = steps.withColumn("n", n)
    found = rows.select("plan", "step", fault.alias("fault")).filter("fault is not null").union(rows.filter(F.col("n") > most).select("plan", F.lit(0), F.lit("too_many")))
    return found.groupBy("plan").agg(F.min(F.struct("step", "fault")).alias("f")).select("plan", "f.step", "f.fault")


def gate(kind: Column, breaking: Column, outside: Column, policy: dict) -> Column:
    """Why a gate is needed, or null: policy holds plan, breaking, out_of_scope and apply (booleans) and max_breaking."""
    strict, lax = F.lit(policy["breaking"]), F.lit(not policy["breaking"])
    return (
        F.when((kind == "plan") & F.lit(policy["plan"]), "plans_gated")
        .when((kind == "impact") & strict & (breaking > 0), F.concat(F.lit("breaks:"), breaking))
        .when((kind == "impact") & lax & (breaking > policy["max_breaking"]), F.concat(F.lit("over_limit:"), breaking))
        .when((kind == "out_of_scope") & F.lit(policy["out_of_scope"]) & (outside > 0), F.concat(F.lit("outside:"), outside))
        .when((kind == "apply") & F.lit(policy["apply"]), "apply_gated").when(kind == "budget", "budget")
    )


#: How long a lease lasts, in seconds (fixed value).
LEASE_SECONDS = 60


def lease_log(requests: DataFrame, ttl: int = LEASE_SECONDS) -> DataFrame:
    """(worktree, seq, granted, holder, expires): each request's outcome and the lease after it; holder and expires null where none.

    requests: worktree, seq, at (seconds), who, op (acquire, renew or release); null worktrees are left out, and a null who is refused. An acquire fails while
    another holds a lease that has not ended; the holder re-enters. Renewing and releasing is for the holder alone, ended or not;
    a release without a lease is granted nothing. Each request depends on the ones before it, so worktrees are dealt to
    partitions and read in order, a batch at a time.
    """
    import pandas as pd

    def run(batches):
        tree, holder, ends = None, None, None
        for batch in batches:
            out = []
            for w, seq, at, who, op in batch.itertuples(index=False):
                if w != tree:
                    tree, holder, ends = w, None, None
                ok = who is not None and (holder == who if op != "acquire" else holder in (None, who) or ends <= at)
                if ok:
                    holder, ends = (None, None) if op == "release" else (who, at + ttl)
                out.append((w, seq, ok, holder, ends))
            frame = pd.DataFrame(out, columns=["worktree", "seq", "granted", "holder", "expires"])
            yield frame.astype({"holder": "object", "expires": "Int64"})

    rows = requests.filter("worktree is not null").select(F.col("worktree").cast("string"), F.col("seq").cast("long"), F.col("at").cast("long"), F.col("who").cast("string"), "op")
    return rows.repartition("worktree").sortWithinPartitions("worktree", "seq").mapInPandas(run, "worktree string, seq long, granted boolean, holder string, expires long")


def lease_counts(leases: DataFrame, now: int) -> DataFrame:
    """One row (live, expired): leases (worktree, holder, expires; one row each) that are held, by whether they end after now (seconds)."""
    held = leases.filter("holder is not null and expires is not null")
    return held.agg(F.count_if(F.col("expires") > now).alias("live"), F.count_if(F.col("expires") <= now).alias("expired"))


def matched_calls(calls: DataFrame, operations: DataFrame, key: list[str]) -> DataFrame:
    """calls with the seq of the last operation of the same key, null where there is none."""
    last = operations.groupBy(*key).agg(F.max("seq").alias("seq"))
    return calls.join(last, key, "left")


def broken_chain(operations: DataFrame) -> DataFrame:
    """(task, seq): completed operations whose candidate_before is not the candidate_after of the completed one before."""
    before = F.lag("candidate_after").over(Window.partitionBy("task").orderBy("seq"))
    return operations.filter("candidate_after is not null").withColumn("was", before).filter("was is not null and candidate_before <> was").select("task", "seq")


#: How an open operation stands (fixed values).
COMPLETE, NOT_APPLIED, PARTIAL, UNKNOWN = "complete", "not_applied", "partial", "unknown"


def open_operations(operations: DataFrame, files: DataFrame) -> DataFrame:
    """(task, seq, applied): operations without an outcome, edits among them held against their file as it is.

    operations: task, seq, kind, outcome, path, before_hash, after_hash; files: task, path, hash. An edit is complete where the
    file has its after hash, not applied where it has the before hash or is missing, else partial. Other kinds are unknown.
    """
    rows = operations.filter("outcome is null").join(files, ["task", "path"], "left")
    edit = (F.col("kind") == "edit") & F.col("path").isNotNull()
    applied = F.when(~edit, UNKNOWN).when(F.col("hash").isNull(), NOT_APPLIED).when(F.col("hash") == F.col("after_hash"), COMPLETE).when(F.col("hash") == F.col("before_hash"), NOT_APPLIED).otherwise(PARTIAL)
    return rows.select("task", "seq", F.coalesce(applied, F.lit(UNKNOWN)).alias("applied"))


def recovered(tasks: DataFrame, operations: DataFrame, files: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row a live task: (task, last_completed, drifted, open, inspected, edits, accepted, rejected, stale, next_action, inspected_paths, edited_paths).

    tasks: task, state, current (the candidate as the worktree is, null if unknown), plan_head (first step left, null if none);
    operations as in open_operations with candidate_after and accepted; evidence: task, candidate. Tasks that are done, failed
    or cancelled are left out. Drift is a current candidate other than the last completed one. The next action is, in this order: the
    first partial operation, validating anew after drift, stale evidence, the plan's next step, a new plan.
    """
    live = tasks.filter("state not in ('done', 'failed', 'cancelled')")
    done = F.col("outcome").isNotNull()
    folded = operations.groupBy("task").agg(
        F.max_by(F.when(done, F.col("candidate_after")), F.when(done & (F.col("candidate_after") != ""), F.col("seq"))).alias("last_completed"),
        F.count_if(F.expr("outcome is null")).alias("open"), F.count_if(F.expr("kind = 'edit' and outcome is not null and path is not null")).alias("edits"),
        F.array_sort(F.collect_set(F.when(F.expr("kind = 'inspect_file'"), F.col("path")))).alias("inspected_paths"),
        F.array_sort(F.collect_set(F.when(F.expr("kind = 'edit' and outcome is not null"), F.col("path")))).alias("edited_paths"),
        F.count_if(F.expr("kind = 'decision' and accepted")).alias("accepted"), F.count_if(F.expr("kind = 'decision' and not coalesce(accepted, false)")).alias("rejected"),
    )
    partial = open_operations(operations, files).filter(F.col("applied") == PARTIAL).groupBy("task").agg(F.min("seq").alias("at"))
    stale = live.join(evidence, "task").groupBy("task").agg(F.count_if(F.expr("current <> '' and candidate <> '' and candidate <> current")).alias("stale"))
    out = live.join(folded, "task", "left").join(partial, "task", "left").join(stale, "task", "left").fillna(0, ["open", "edits", "accepted", "rejected", "stale"])
    none = F.array().cast("array<string>")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("inspected_paths", "edited_paths")}).withColumn("inspected", F.size("inspected_paths").cast("long"))
    out = out.withColumn("drifted", F.coalesce(F.expr("last_completed <> '' and current <> '' and last_completed <> current"), F.lit(False)))
    action = F.when(F.col("at").isNotNull(), F.concat(F.lit("reconcile:"), "at")).when(F.col("drifted"), "validate").when(F.col("stale") > 0, "revalidate").when(F.col("plan_head").isNotNull(), F.concat(F.lit("step:"), "plan_head")).otherwise("plan")
    return out.select("task", "last_completed", "drifted", "open", "inspected", "edits", "accepted", "rejected", "stale", action.alias("next_action"), "inspected_paths", "edited_paths")


def memo_key(version: Column, workspace: Column, analyzer: Column, digest: Column) -> Column:
    return F.sha2(F.concat_ws("\0", version, workspace, analyzer, digest), 256)


def to_analyze(work: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows of work whose key the cache does not have."""
    return work.join(cache.select("key"), "key", "left_anti")


def refreshed(old: DataFrame, new: DataFrame, dirty: DataFrame, scope: str) -> DataFrame:
    """old rows of clean scopes and new rows of dirty ones: only what is dirty is read anew."""
    return old.join(dirty, scope, "left_anti").unionByName(new.join(dirty, scope, "left_semi"))


def totals(daily: DataFrame, since: str | None = None, name: str | None = None, workspace: int | None = None) -> DataFrame:
    """(workspace_id, kind, name, n, total_ms) of daily counts (and day, as text) from a day on, of one name, of one workspace; each may be left out."""
    for column, value, holds in (("day", since, Column.__ge__), ("name", name, Column.__eq__), ("workspace_id", workspace, Column.__eq__)):
        if value is not None:
            daily = daily.filter(holds(F.col(column), F.lit(value)))
    return daily.groupBy("workspace_id", "kind", "name").agg(F.sum("n").alias("n"), F.sum("total_ms").alias("total_ms"))
