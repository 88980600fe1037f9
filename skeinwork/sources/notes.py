"""Note cards: text files with a head of fields between two lines of dashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cards that count, and bytes that one may have (fixed values).
CARDS = ("project", "architecture", "conventions", "constraints", "decisions", "glossary")
MOST_BYTES = 16_000


def cards(spark: SparkSession, folder: str, names: tuple[str, ...] = CARDS) -> tuple[DataFrame, DataFrame]:
    """(notes, rejects): the cards of a folder, and (file, reason) of those that are too large or have no head.

    notes: note_id (the card's name), file, repository, commit, updated_at (seconds), source, symbols and text. The head has a field
    on each line, `name: value`; symbols are a list in brackets or on lines of their own that begin with a dash. A field that is not
    there is null, symbols are empty. updated_at is a date with a time, or null where it is none.
    """
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.md$", "")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder).select(F.col("path").alias("file"), name.alias("note_id"), "length", "content").filter(F.col("note_id").isin(*names))
    parts = F.split(F.decode("content", "utf-8"), "---\n", 3)
    rows = files.withColumn("p", F.when(F.col("length") <= MOST_BYTES, parts))
    reason = F.when(F.col("length") > MOST_BYTES, "too_large").when((F.size("p") < 3) | (F.get("p", F.lit(0)) != ""), "no_head")
    rows = rows.withColumn("reason", reason)
    head = F.concat(F.lit("\n"), F.get("p", F.lit(1)))
    bare = lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")
    field = lambda key: F.nullif(bare(F.regexp_extract(head, rf"\n{key}:[ \t]*([^\n]*)", 1)), F.lit(""))
    inline = F.split(F.regexp_extract(head, r"\nsymbols:[ \t]*\[([^\]\n]*)\]", 1), ",")
    below = F.split(F.regexp_extract(head, r"\nsymbols:[ \t]*\n((?:[ \t]*-[^\n]*\n?)+)", 1), r"\n?[ \t]*-[ \t]+")
    symbols = F.filter(F.transform(F.concat(inline, below), lambda x: bare(F.regexp_replace(x, r"\s+$", ""))), lambda x: x != "")
    notes = rows.filter("reason is null").select(
        "note_id", "file", field("repo_id").alias("repository"), field("commit").alias("commit"), F.unix_timestamp(F.try_to_timestamp(field("updated_at"))).alias("updated_at"),
        field("source").alias("source"), symbols.alias("symbols"), F.regexp_replace(F.get("p", F.lit(2)), r"^\s+|\s+$", "").alias("text"),
    )
    return notes, rows.filter("reason is not null").select("file", "reason")
