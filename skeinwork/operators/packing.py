"""Filling budgets in order, and cutting texts to line windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def could_fit(items: DataFrame, budget: int, *order: str | Column) -> DataFrame:
    """items without those that cannot fit, whatever the others are; order is that in which a packet (packet, cost) is filled.

    What is left of a budget never grows, so where an item is passed, all later ones of its cost are: of each cost c above 0 the
    items that fit are among the first budget / c. A task keeps no more of each while it reads, so a packet of any length leaves a
    few thousand rows.
    """
    first = F.row_number().over(Window.partitionBy("packet", "cost").orderBy(*order))
    some = items.filter("cost > 0").withColumn("_k", first).filter(F.col("_k") <= budget).filter(F.col("_k") * F.col("cost") <= budget).drop("_k")
    return some.unionByName(items.filter("cost <= 0"))


def greedy_fill(items: DataFrame, budget: int) -> DataFrame:
    """(packet, seq, cost, used) of items that fit: each in order of seq, one over the budget is passed and the next tried.

    items: packet, seq, cost; seq is unique within a packet, a cost is 0 at least. A running sum cannot say this, as what is passed
    costs nothing. What could fit is found by packet and cost in all tasks; those packets are dealt to partitions and read in order,
    a task holds one batch and the budget used so far.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packet, used = None, 0
        for batch in batches:
            keep, after = [], []
            for p, cost in zip(batch["packet"].tolist(), batch["cost"].tolist()):
                if cost < 0:
                    raise ValueError(f"packet {p} has an item that costs {cost}")
                if p != packet:
                    packet, used = p, 0
                fits = used + cost <= budget
                used += cost if fits else 0
                keep.append(fits)
                after.append(used)
            yield batch.assign(used=after)[keep]

    rows = items.filter("packet is not null and cost is not null").select(F.col("packet").cast("long"), F.col("seq").cast("long"), F.col("cost").cast("long"))
    return could_fit(rows, budget, "seq").repartition("packet").sortWithinPartitions("packet", "seq").mapInPandas(run, "packet long, seq long, cost long, used long")


def newest_within(items: DataFrame, budget: int) -> DataFrame:
    """(packet, seq, cost): each packet's items from the newest on that fit the budget; one over it is passed and an older one tried."""
    kept = greedy_fill(items.withColumn("seq", -F.col("seq")), budget)
    return kept.select("packet", (-F.col("seq")).alias("seq"), "cost")


def head_tail(text: Column, head: int = 60, tail: int = 40, limit: int = 103) -> Column:
    """The text, or its first and last lines about a line that says how many were left out."""
    lines = F.split(text, "\n", -1)
    n = F.size(lines)
    said = F.concat(F.lit("... "), (n - head - tail).cast("string"), F.lit(" lines ..."))
    return F.when(n <= limit, text).otherwise(F.array_join(F.concat(F.slice(lines, 1, head), F.array(said), F.slice(lines, -tail, tail)), "\n"))


def line_chunks(docs: DataFrame, size: int = 60) -> DataFrame:
    """(doc_id, first, last, body): windows of `size` lines that do not overlap, lines counted from 1; the rest is the last."""
    lines = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    starts = lines.withColumn("i", F.explode(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / size).cast("int"))))
    part = F.slice("lines", F.col("i") * size + 1, F.lit(size))
    return starts.select("doc_id", (F.col("i") * size + 1).alias("first"), (F.col("i") * size + F.size(part)).alias("last"), F.array_join(part, "\n").alias("body"))
