"""Context packets: what a step is given to read, under several budgets at once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .paths import sensitive

#: Where items come from, in the order in which a packet is filled (fixed values).
ORIGINS = ("project_note", "note", "impact", "anchor", "explicit", "graph")
#: Kinds of notes, in the order in which a reader sees them (fixed values).
NOTE_KINDS = ("intent", "observation", "advice")
#: Shares of the budget that each kind of notes and what the graph adds may take (fixed values).
NOTE_SHARE, GRAPH_SHARE = 0.15, 0.33
#: Who may have written a note that counts (fixed values).
NOTE_SOURCES = ("user", "model_accepted", "tool")


def _bytes(*texts: Column) -> Column:
    total = F.lit(0)
    for t in texts:
        total = total + F.octet_length(F.coalesce(t, F.lit("")))
    return total


def slice_tokens(*texts: Column) -> Column:
    """Token estimate of a slice's or a note's texts together."""
    return (F.floor(_bytes(*texts) / 4) + 8).cast("long")


def message_tokens(text: Column) -> Column:
    return (F.floor(_bytes(text) / 4) + 1).cast("long")


def map_entry_tokens(text: Column) -> Column:
    return (F.floor(_bytes(text) / 3) + 20).cast("long")


def project_note_tokens(text: Column) -> Column:
    return (F.floor(_bytes(text) / 3) + 100).cast("long")


def stale_notes(notes: DataFrame, repository: str, symbols: DataFrame) -> DataFrame:
    """notes with stale, the reason why a note no longer counts, or null: the last that applies of provenance, source, symbol.

    notes: note_id, repository, commit, updated_at, source, symbols (array). A note needs the repository it is read in, a commit and a
    time, a source of NOTE_SOURCES, and each of its symbols among the known ones (name). Symbols meet names by equal key.
    """
    named = notes.select("note_id", F.explode("symbols").alias("name")).distinct()
    lost = named.join(symbols.select("name").distinct(), "name", "left_anti").groupBy("note_id").agg(F.max("name").alias("lost"))
    unknown = ~F.col("repository").eqNullSafe(F.lit(repository)) | (F.coalesce("commit", F.lit("")) == "") | F.col("updated_at").isNull()
    unread = ~F.coalesce("source", F.lit("")).isin(*NOTE_SOURCES)
    why = F.when(F.col("lost").isNotNull(), F.concat(F.lit("symbol:"), "lost")).when(unread, "source").when(unknown, "provenance")
    return notes.join(lost, "note_id", "left").withColumn("stale", why).drop("lost")


def assemble(items: DataFrame, requests: DataFrame) -> DataFrame:
    """(packet, origin, seq, cost, verdict, used): what becomes of every item; used is the packet's tokens after it, null where it is decided before.

    requests: packet, workspace, budget. items: packet, origin of ORIGINS, seq (unique in packet and origin), score, kind (of a note), stale
    (of a note, null if it is not), node_id (null or 0: none), workspace, repository, path, hash, version, cost.

    Filled in the order of ORIGINS: project notes and impact by seq, notes by kind and then from the newest (largest seq) on, the
    rest by score, best first, then seq. An item that does not fit is passed and the next one tried. Project notes and notes have
    a share each, and the graph's items one, within the budget; impact is charged and never left out for its cost. Verdicts:
    `kept`; `foreign` of another workspace and `invalid` without its provenance, both of slices alone; `sensitive` by path;
    `repeat` of a node that came before, kept or not; `stale`; `note_share`, `graph_share` and `budget` for what did not fit.

    What needs no running total is decided first, by predicates and one aggregate. The rest is read in order: packets are dealt to
    partitions and sorted, a task holds one batch and four numbers, however long a packet is.
    """
    note = F.col("origin").isin("project_note", "note")
    stage = F.array_position(F.array(*map(F.lit, ORIGINS)), F.col("origin"))
    by_kind = F.when(F.col("origin") == "note", F.array_position(F.array(*map(F.lit, NOTE_KINDS)), F.col("kind"))).otherwise(0)
    ranked = F.col("origin").isin("anchor", "explicit", "graph")
    place = F.struct(stage.alias("stage"), by_kind.alias("kind"), F.when(ranked, -F.col("score")).otherwise(0.0).alias("worse"), F.when(F.col("origin") == "note", -F.col("seq")).otherwise(F.col("seq")).alias("seq"))
    asked = requests.select("packet", F.col("workspace").alias("active"), "budget")
    rows = items.join(asked, "packet").select(
        "packet", "origin", "seq", "cost", "budget", place.alias("place"), F.when(~note & (F.coalesce("node_id", F.lit(0)) != 0), F.col("node_id")).alias("node_id"),
        F.when(note & F.col("stale").isNotNull(), "stale")
        .when(~note & ~F.col("workspace").eqNullSafe(F.col("active")), "foreign")
        .when(~note & (_blank("workspace") | _blank("repository") | _blank("path") | _blank("hash") | (F.coalesce("version", F.lit(0)) == 0)), "invalid")
        .when(~note & sensitive(F.col("path")), "sensitive").alias("verdict"),
    )
    first = rows.filter("verdict is null and node_id is not null").groupBy("packet", "node_id").agg(F.min("place").alias("first"))
    rows = rows.join(first, ["packet", "node_id"], "left").withColumn("verdict", F.when(F.col("verdict").isNull() & (F.col("first") != F.col("place")), "repeat").otherwise(F.col("verdict")))
    decided = rows.filter("verdict is not null").select("packet", "origin", "seq", "cost", "verdict", F.lit(None).cast("long").alias("used"))
    left = rows.filter("verdict is null").select("packet", "origin", F.col("seq").cast("long"), F.col("cost").cast("long"), F.col("budget").cast("long"), "place")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used, shares, spent = None, 0, {}, {}
        for batch in batches:
            verdicts, after = [], []
            for packet, origin, cost, budget in zip(batch["packet"].tolist(), batch["origin"].tolist(), batch["cost"].tolist(), batch["budget"].tolist()):
                if packet != now:
                    now, used, spent = packet, 0, {}
                    shares = {"project_note": int(budget * NOTE_SHARE), "note": int(budget * NOTE_SHARE), "graph": int(budget * GRAPH_SHARE)}
                part = spent.get(origin, 0) + cost
                if origin in shares and part > shares[origin]:
                    verdict = "graph_share" if origin == "graph" else "note_share"
                elif origin in ("anchor", "explicit", "graph") and used + cost > budget:
                    verdict = "budget"
                else:
                    verdict, used, spent[origin] = "kept", used + cost, part
                verdicts.append(verdict)
                after.append(used)
            yield batch[["packet", "origin", "seq", "cost"]].assign(verdict=verdicts, used=after)

    ordered = left.repartition("packet").sortWithinPartitions("packet", "place").drop("place")
    kind = left.schema["packet"].dataType.simpleString()
    return decided.unionByName(ordered.mapInPandas(fill, f"packet {kind}, origin string, seq long, cost long, verdict string, used long"))


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) == ""


def packet_totals(assembled: DataFrame, requests: DataFrame) -> DataFrame:
    """(packet, slices, notes, tokens, dropped, notes_dropped, rejected) of every packet asked for, also one without items."""
    note = F.col("origin").isin("project_note", "note")
    kept = F.col("verdict") == "kept"
    sums = assembled.groupBy("packet").agg(
        F.count_if(kept & ~note).alias("slices"), F.count_if(kept & note).alias("notes"), F.sum(F.when(kept, F.col("cost")).otherwise(0)).alias("tokens"),
        F.count_if(F.col("verdict").isin("sensitive", "graph_share", "budget")).alias("dropped"), F.count_if(F.col("verdict").isin("note_share", "stale")).alias("notes_dropped"),
        F.count_if(F.col("verdict").isin("foreign", "invalid")).alias("rejected"),
    )
    names = ["slices", "notes", "tokens", "dropped", "notes_dropped", "rejected"]
    return requests.select("packet").distinct().join(sums, "packet", "left").select("packet", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names])
