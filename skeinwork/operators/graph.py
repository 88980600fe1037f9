"""Bounded traversal, impact and PageRank over edge tables; the loops run on the driver, each level is a Spark job."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import Files, Scratch, shared_dir

#: Evidence from strongest to weakest; the first two are certain (fixed values).
EVIDENCE = ("resolved", "declared", "inferred", "observed", "unknown")
#: Verdict of a change for consumers whose edge no rule names, and what to do about them (verdicts are fixed values).
DEFAULTS = {
    "remove": ("breaking", "take the use out before the definition goes"),
    "rename": ("compiles", "run its tests"),
    "signature": ("compiles", "run its tests"),
    "add_field": ("compatible", ""),
    "behaviour": ("compiles", "run its tests for the new behaviour"),
    "schema": ("compiles", "run its tests"),
    "config": ("compiles", ""),
    "route": ("compiles", ""),
}
#: (change, edge kind, verdict, what to do); changes, kinds and verdicts are fixed values.
RULES = (
    *(("rename", via, "breaking", "use the new name") for via in ("calls", "uses_type", "references", "implements", "imports", "extends", "embeds")),
    ("rename", "reads_config", "breaking", "rename the key wherever it is set"),
    *(("signature", via, "breaking", "call it by the new signature") for via in ("calls", "returns", "accepts")),
    ("signature", "implements", "breaking", "implement the new signature"),
    ("signature", "tests", "breaking", "test the new signature"),
    ("add_field", "implements", "breaking", "implement the new member"),
    ("add_field", "uses_type", "compiles", "look for literals and switches that list all members"),
    ("behaviour", "tests", "breaking", "decide whether the tested behaviour still holds"),
    *(("schema", via, "breaking", "migrate the data and its queries") for via in ("reads_schema", "writes_schema")),
    ("schema", "tests", "breaking", "renew its fixtures"),
    ("config", "reads_config", "breaking", "change the key here and wherever it is set"),
    *(("config", via, "breaking", "change the deployment") for via in ("deploys", "provisions")),
    *(("route", via, "breaking", "register the new route") for via in ("routes_to", "handles")),
    ("route", "references", "breaking", "call the new route"),
    ("route", "tests", "breaking", "test the new route"),
)
#: Verdicts as a report lists them (fixed values).
ORDER = ("breaking", "undetermined", "compiles", "compatible")
CAVEAT = "an edge that is missing was not found, which does not mean that there is none; consumers by weak evidence are listed too"
#: Nodes that a walk takes in, and edges deep (fixed values).
MOST_NODES, MOST_DEPTH = 5000, 6


def neighbours(edges: DataFrame, node_id: int, reverse: bool = False) -> DataFrame:
    return edges.filter(F.col("dst" if reverse else "src") == node_id).orderBy("kind", "src", "dst")


def settled(df: DataFrame) -> DataFrame:
    """df checkpointed in spark.checkpoint.dir: a loop's plan stays as long as one round's, and a lost executor loses nothing."""
    spark: SparkSession = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


@dataclass(frozen=True)
class Adjacency:
    """Edges stored twice, by buckets of either end, so a step of a walk reads the buckets of its frontier alone."""

    spark: SparkSession
    folder: str
    buckets: int = 64

    def write(self, edges: DataFrame) -> Adjacency:
        """Store edges (src, dst, kind, rank). A hub's edges are written by several tasks, so none has them all."""
        for end, other in (("src", "dst"), ("dst", "src")):
            rows = edges.select("src", "dst", "kind", "rank").withColumn("bucket", self._bucket(end))
            rows.repartition("bucket", F.pmod(F.xxhash64(other), F.lit(8))).sortWithinPartitions("bucket", end).write.partitionBy("bucket").mode("overwrite").parquet(f"{self.folder}/by_{end}")
        return self

    def _bucket(self, end: str) -> Column:
        return F.pmod(F.xxhash64(F.col(end).cast("long")), F.lit(self.buckets)).cast("int")

    def at(self, frontier: DataFrame, end: str) -> DataFrame:
        """Edges of the buckets that hold the frontier's nodes (node_id) at that end; the buckets are numbers, no more than there are."""
        wanted = [r.b for r in frontier.select(self._bucket("node_id").alias("b")).distinct().collect()]
        schema = "src long, dst long, kind string, rank int, bucket int"
        if not Files(self.spark, f"{self.folder}/by_{end}").names():
            return self.spark.createDataFrame([], schema).drop("bucket")
        return self.spark.read.schema(schema).parquet(f"{self.folder}/by_{end}").filter(F.col("bucket").isin(wanted)).drop("bucket")

    def free(self) -> None:
        Files(self.spark, self.folder).delete()


@dataclass(frozen=True)
class Walk:
    """What a walk reached (node_id, depth, rank, via), and whether its cap left out nodes that lie within its depth."""

    reached: DataFrame
    truncated: bool


def walk(edges: DataFrame | Adjacency, start: DataFrame, depth: int = 1, reverse: bool = False, kinds: list[str] | None = None, ranks: list[int] | None = None, most: int | None = None) -> Walk:
    """Every node within depth hops once, at its shortest depth, and at most `most` of them, those of start among them.

    rank is the least over paths of that depth of the weakest hop's rank; via is the kind of the last hop of that path, the
    first by name of equals. start has node_id; its rows have depth 0, rank 0 and no via. kinds and ranks name the edges that
    count. Each level is written, so a plan has one level; an empty one ends the walk.

    A level takes in as many of its nodes as there is room for, the smallest node_id first, and one that fills the cap is the last.
    Where it was filled exactly, one node of the next level is looked for, so truncated is exact.
    """
    if not 0 < depth <= MOST_DEPTH:
        raise ValueError(f"depth must be from 1 to {MOST_DEPTH}")
    here, there = ("dst", "src") if reverse else ("src", "dst")
    frontier = settled(start.select("node_id", F.lit(0).alias("depth"), F.lit(0).alias("rank"), F.lit(None).cast("string").alias("via")).distinct())
    found, room = frontier, None if most is None else max(0, most - frontier.count())
    for level in range(1, depth + 1):
        near = edges.at(frontier, here) if isinstance(edges, Adjacency) else edges
        if kinds:
            near = near.filter(F.col("kind").isin(kinds))
        if ranks:
            near = near.filter(F.col("rank").isin(ranks))
        step = near.join(frontier.select(F.col("node_id").alias(here), F.col("rank").alias("so_far")), here)
        best = step.groupBy(F.col(there).alias("node_id")).agg(F.min(F.struct(F.greatest("rank", "so_far").alias("rank"), F.col("kind").alias("via"))).alias("b"))
        fresh = best.join(found.select("node_id"), "node_id", "left_anti").select("node_id", F.lit(level).alias("depth"), "b.rank", "b.via")
        if room == 0:
            return Walk(found, not fresh.isEmpty())
        frontier = settled(fresh if room is None else fresh.orderBy("node_id").limit(room + 1))
        if room is None:
            if frontier.isEmpty():
                break
        else:
            n = frontier.count()
            if n > room:
                return Walk(found.unionByName(frontier.orderBy("node_id").limit(room)), True)
            if not n:
                break
            room -= n
        found = found.unionByName(frontier)
    return Walk(found, False)


def traverse(edges: DataFrame | Adjacency, start: DataFrame, depth: int = 1, reverse: bool = False, kinds: list[str] | None = None, ranks: list[int] | None = None) -> DataFrame:
    """What walk() reaches without a cap."""
    return walk(edges, start, depth, reverse, kinds, ranks).reached


def rules(spark: SparkSession, changes: list[str] | None = None) -> DataFrame:
    """(change, via, verdict, step) as a table of some forty rows; the default of a change has a null via."""
    rows = [(c, None, *d) for c, d in DEFAULTS.items()] + list(RULES)
    return spark.createDataFrame([r for r in rows if changes is None or r[0] in changes], "change string, via string, verdict string, step string")


def judged(consumers: DataFrame, changes: DataFrame) -> DataFrame:
    """consumers (rank, via) under each change (change), with verdict and step by rules(); weak evidence leaves it undetermined."""
    spark = consumers.sparkSession
    table = rules(spark)
    named = table.filter("via is not null").select("change", "via", F.col("verdict").alias("v"), F.col("step").alias("s"))
    rest = table.filter("via is null").select("change", F.col("verdict").alias("dv"), F.col("step").alias("ds"))
    # a change's consumers are listed under it; both tables of rules are short
    listed = consumers.withColumn("change", F.explode(changes.select(F.sort_array(F.collect_set("change")).alias("c")).scalar()))
    out = listed.join(F.broadcast(named), ["change", "via"], "left").join(F.broadcast(rest), "change")
    weak = F.element_at(F.array(*map(F.lit, EVIDENCE)), F.col("rank") + 1)
    unsure = F.col("rank") > 1
    return out.select(
        *listed.columns, F.when(unsure, "undetermined").otherwise(F.coalesce("v", "dv")).alias("verdict"),
        F.when(unsure, F.concat(F.lit("check by hand: evidence is "), weak)).otherwise(F.coalesce("s", "ds")).alias("step"),
    )


def impact(edges: DataFrame | Adjacency, nodes: DataFrame, start: DataFrame, change: str, depth: int = 3) -> DataFrame:
    """Consumers of the start nodes with a verdict; evidence weaker than declared leaves it undetermined."""
    if change not in DEFAULTS:
        raise ValueError(f"unknown change {change}")
    reached = traverse(edges, start, depth, reverse=True).filter("depth > 0")
    one = reached.sparkSession.range(1).select(F.lit(change).alias("change"))
    return judged(reached, one).join(nodes, "node_id").select("node_id", "kind", "fqn", "depth", "rank", "via", "verdict")


def impact_lines(edges: DataFrame | Adjacency, nodes: DataFrame, start: DataFrame, change: str, depth: int = 3, most: int = MOST_NODES) -> DataFrame:
    """The report as it is read: (place, verdict, depth, path, fqn, kind, node_id, via, evidence, step, truncated, caveat).

    nodes: node_id, kind, fqn, path (null: none). place counts from 1 by verdict in ORDER, depth, path, fqn and node_id. The walk
    takes in `most` nodes, so the report is numbered in one task whatever the graph's size; truncated says that there are more.
    """
    if change not in DEFAULTS:
        raise ValueError(f"unknown change {change}")
    found = walk(edges, start, depth, reverse=True, most=most)
    one = start.sparkSession.range(1).select(F.lit(change).alias("change"))
    rows = judged(found.reached.filter("depth > 0"), one).join(nodes.select("node_id", "kind", "fqn", F.coalesce("path", F.lit("")).alias("path")), "node_id")
    order = Window.partitionBy(F.lit(0)).orderBy(F.array_position(F.array(*map(F.lit, ORDER)), F.col("verdict")), "depth", "path", "fqn", "node_id")
    evidence = F.element_at(F.array(*map(F.lit, EVIDENCE)), F.col("rank") + 1)
    return rows.select(F.row_number().over(order).cast("long").alias("place"), "verdict", "depth", "path", "fqn", "kind", "node_id", "via", evidence.alias("evidence"), "step", F.lit(found.truncated).alias("truncated"), F.lit(CAVEAT).alias("caveat"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 40, damping: float = 0.85) -> DataFrame:
    """(node_id, score) after a fixed number of rounds; the mass of nodes without out-edges is spread evenly.

    A node that nothing links to has the same score as all others of its kind, in every round: one number stands for them. A node
    that only such nodes link to has in every round that number and a weight times the one of the round before, and so on: nodes are
    taken off in levels, each level's with a weight for every round back, and what they give to the others is weights too. Levels go
    on while one takes at least half of the nodes left. Rounds go over the rest alone, the nodes on circles and behind them, and the
    links between those; where nothing is left, rounds are a few numbers. Links, nodes and scores are stored in buckets of their
    source or node, so they meet where they lie and what is shuffled is one partial sum a target and task. Each round is written, the one
    before it is freed, and one number of it, the idle mass, comes to the driver as it is written.
    """
    spark = nodes.sparkSession
    scratch, width = Scratch(spark, "pagerank"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = nodes.count()
    if not n:
        return nodes.select("node_id", F.lit(0.0).alias("score"))
    links = scratch.write_bucketed(edges.select("src", "dst").filter("src is not null").repartition(width, "src"), "all-links", "src", width)
    degree = links.groupBy("src").agg(F.count("*").alias("degree"))
    rest = nodes.select("node_id").hint("merge").join(degree, F.col("node_id") == F.col("src"), "left").select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"))
    # levels: nodes with w0, w1, ..., what they get of an unlinked node's score one, two, ... rounds back; idle: what all of them keep idle of it
    levels, idle, left, stored = [], [], n, ["all-links"]
    while left:
        back = len(levels)
        linked = links.select(F.col("dst").alias("node_id")).distinct().withColumn("linked", F.lit(True))
        placed = rest.hint("merge").join(linked, "node_id", "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
        placed = scratch.write_bucketed(placed, f"placed-{back}", "node_id", width)
        for name in stored[:-1]:
            scratch.drop(name)
        stored = stored[-1:]
        own = [F.lit(1.0), *[damping * F.col(f"w{i}") for i in range(back)]]
        off = placed.filter("not linked").agg(F.count("*").alias("n"), *[F.coalesce(F.sum(F.when(F.col("degree") == 0, w)), F.lit(0.0)).alias(f"idle{i}") for i, w in enumerate(own)]).first()
        if back and 2 * off["n"] < left:
            rest = placed
            break
        levels.append(placed.filter("not linked").drop("linked"))
        idle = [off[f"idle{i}"] + (idle[i] if i < len(idle) else 0.0) for i in range(back + 1)]
        left -= off["n"]
        if not left:
            break
        # a link whose source is no node gives nothing
        shares = placed.filter("not linked and degree > 0").select(F.col("node_id").alias("src"), *[(w / F.col("degree")).alias(f"g{i}") for i, w in enumerate(own)])
        given = links.hint("merge").join(shares, "src").groupBy(F.col("dst").alias("node_id")).agg(*[F.sum(f"g{i}").alias(f"g{i}") for i in range(back + 1)])
        weights = [(F.coalesce(f"g{i}", F.lit(0.0)) + (F.col(f"w{i}") if i < back else 0.0)).alias(f"w{i}") for i in range(back + 1)]
        rest = placed.filter("linked").hint("merge").join(given, "node_id", "left").select("node_id", "degree", *weights)
        between = links.hint("merge").join(placed.filter("linked").select(F.col("node_id").alias("src")), "src", "left_semi")
        stored.append(f"links-{back}" if back else "links")
        links = scratch.write_bucketed(between, stored[-1], "src", width)
    # an unlinked node's score after every round so far
    apart, depth = [1.0 / n], len(levels)
    before = lambda step, i: apart[step - 1 - i] if i < step else 0.0
    given_back = lambda step, k: sum((F.col(f"w{i}") * before(step, i) for i in range(k)), F.lit(0.0))
    idle_of = F.coalesce(F.sum(F.when(F.col("degree") == 0, F.col("score"))), F.lit(0.0)).alias("idle")
    for step in range(rounds + 1):
        if step:
            kept = (seen.get["idle"] if left else 0.0) + sum(x * before(step, i) for i, x in enumerate(idle))
            apart.append((1 - damping) / n + damping * kept / n)
        if left:
            start = rest.select("node_id", "degree", *[f"w{i}" for i in range(depth)], F.lit(1.0 / n).alias("score"))
            if step:
                part = scores.filter("degree > 0").select(F.col("node_id").alias("src"), (F.col("score") / F.col("degree")).alias("part"))
                got = links.hint("merge").join(part, "src").groupBy(F.col("dst").alias("node_id")).agg(F.sum("part").alias("got"))
                new = apart[step] + damping * (F.coalesce("got", F.lit(0.0)) + given_back(step, depth))
                start = scores.hint("merge").join(got, "node_id", "left").select("node_id", "degree", *[f"w{i}" for i in range(depth)], new.alias("score"))
            seen = Observation(f"idle-{step}")
            scores = scratch.write_bucketed(start.observe(seen, idle_of), f"scores-{step}", "node_id", width)
            if step:
                scratch.drop(f"scores-{step - 1}")
    scratch.drop(stored[-1])
    parts = [level.select("node_id", (apart[rounds] + damping * given_back(rounds, k)).alias("score")) for k, level in enumerate(levels)]
    return reduce(DataFrame.unionByName, parts + ([scores.select("node_id", "score")] if left else []))


def by_name(nodes: DataFrame, names: DataFrame, kinds: list[str], limit: int = 100) -> DataFrame:
    """The first `limit` nodes (node_id, kind, fqn) of the kinds whose fqn is asked for (fqn), by kind and fqn."""
    return nodes.filter(F.col("kind").isin(kinds)).join(names, "fqn", "left_semi").orderBy("kind", "fqn").limit(limit)


def public_impact(report: DataFrame, hidden: Column) -> DataFrame:
    """(verdict, n, truncated): consumers by verdict without those that are hidden; truncated where any consumer was."""
    counts = report.groupBy("verdict").agg(F.count_if(~hidden).alias("n"), F.count_if(hidden).alias("dropped"))
    return counts.withColumn("truncated", F.sum("dropped").over(Window.partitionBy()) > 0).filter("n > 0").select("verdict", "n", "truncated")


def file_tree(files: DataFrame) -> DataFrame:
    """(parent, child, kind): each directory in its parent and each file in its directory, once each; the root is the empty path."""
    parts = F.split("path", "/", -1)
    levels = files.select(parts.alias("p")).withColumn("i", F.explode(F.sequence(F.lit(1), F.size("p"))))
    path = lambda n: F.array_join(F.slice("p", F.lit(1), n), "/")
    return levels.select(path(F.col("i") - 1).alias("parent"), path(F.col("i")).alias("child"), F.when(F.col("i") == F.size("p"), "file").otherwise("directory").alias("kind")).distinct()


def history(nodes: DataFrame, touches: DataFrame, commits: DataFrame, most_nodes: int = 5, most: int = 10) -> DataFrame:
    """(node_id, commit_id, at): the newest commits that touch each of the first nodes. touches: commit_id, node_id; commits: commit_id, at."""
    few = nodes.select("node_id").orderBy("node_id").limit(most_nodes)
    rows = touches.join(few, "node_id", "left_semi").distinct().join(commits, "commit_id")
    newest = Window.partitionBy("node_id").orderBy(F.desc("at"), F.desc("commit_id"))
    return rows.withColumn("k", F.row_number().over(newest)).filter(F.col("k") <= most).select("node_id", "commit_id", "at")
