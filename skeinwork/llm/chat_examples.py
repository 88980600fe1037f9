"""Operator 12, chat formatting by prefix-target expansion: every assistant turn is an example of its own. DataFrame functions alone."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Template:
    """A turn is written begin, role, then, text, end; `others` are control strings of other templates that are escaped as well.

    A control string in a role or a text gets a backslash after its first sign, and one that has backslashes there already gets
    one more. So none is left as it was, and plain() takes one backslash from each. Control strings have two signs at least, no
    backslash, and nowhere but in front a sign that any of them begins with, so no two of them overlap.
    """

    begin: str = "<s>"
    then: str = "[INST]"
    end: str = "</s>"
    others: tuple[str, ...] = ("[/INST]",)

    def __post_init__(self) -> None:
        every = (self.begin, self.then, self.end, *self.others)
        heads = {c[:1] for c in every}
        if len(set(every)) != len(every) or any(len(c) < 2 or "\\" in c or heads & set(c[1:]) for c in every):
            raise ValueError("control strings must be different, of two signs or more, and hold no backslash and no first sign later on")

    def _around(self, slashes: str) -> str:
        every = (self.begin, self.then, self.end, *self.others)
        return f"({'|'.join(re.escape(c[0]) for c in every)}){slashes}({'|'.join(re.escape(c[1:]) for c in every)})"

    def escaped(self, text: Column) -> Column:
        return F.regexp_replace(text, self._around(r"(\\*)"), r"$1$2\\$3")

    def plain(self, text: Column) -> Column:
        return F.regexp_replace(text, self._around(r"\\(\\*)"), "$1$2$3")


def chat_examples(turns: DataFrame, template: Template = Template(), trained: str = "assistant") -> DataFrame:
    """conv_id, example, text, trained, loss_start, loss_chars and last: one example for each turn of the trained role.

    turns: conv_id, turn, role, text. text is every turn up to that one, formatted; the reply, as escaped, is what lies in
    [loss_start, loss_start + loss_chars) of its code points, and nothing else counts for the loss. Examples are numbered from 1
    in each conversation. One that does not end with the trained role has a last example more with all of its turns, which is
    not trained (loss_chars 0), so nothing of the input is lost. last marks the example that holds the whole conversation.

    Turns are in order of turn, nulls first, then of role and text where turns tie; repeated rows are turns of their own. Null
    text or role is empty. Rows with a null conv_id are one conversation. An empty table gives no rows; extra columns, of
    whatever name, stay out. Turns are formatted before they are grouped; a conversation is one record, as its examples hold all
    of it, and must fit a row; examples are as many as its replies, and their text grows with the square of its length, which
    is what the method asks for. A conversation that many others repeat is grouped under each one's own key, so no key is hot.
    """
    t = template
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(t.begin), t.escaped(role), F.lit(t.then))
    rows = turns.select("conv_id", F.struct("turn", role.alias("role"), t.escaped(text).alias("body"), head.alias("head")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    ends = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (F.element_at("turns", i)["role"] == trained) | (i == F.size("turns")))
    parts = F.transform("turns", lambda x: F.concat(x["head"], x["body"], F.lit(t.end)))
    each = whole.withColumn("parts", parts).select("conv_id", "turns", "parts", F.posexplode(ends).alias("example", "at"))
    each = each.select(
        "conv_id", (F.col("example") + 1).alias("example"), F.array_join(F.slice("parts", F.lit(1), F.col("at") - 1), "").alias("context"),
        F.element_at("parts", F.col("at")).alias("part"), F.element_at("turns", F.col("at")).alias("turn"), (F.col("at") == F.size("turns")).alias("last"),
    )
    is_trained = F.col("turn.role") == trained
    return each.select(
        "conv_id", "example", F.concat("context", "part").alias("text"), is_trained.alias("trained"),
        (F.length("context") + F.length("turn.head")).alias("loss_start"), F.when(is_trained, F.length("turn.body")).otherwise(0).alias("loss_chars"), "last",
    )


def turns_of(text: Column, template: Template = Template()) -> Column:
    """The turns (role, text) that a formatted text was made of."""
    t = template
    pieces = F.split(text, re.escape(t.end), -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    named = F.transform(pieces, lambda p: F.struct(F.substring_index(p, t.then, 1).alias("head"), p.alias("piece")))
    after = lambda x, n: F.substring(x, n, F.length(x))
    return F.transform(named, lambda x: F.struct(
        t.plain(after(x["head"], F.lit(len(t.begin) + 1))).alias("role"), t.plain(after(x["piece"], F.length(x["head"]) + len(t.then) + 1)).alias("text")))


def reply_of(template: Template = Template()) -> Column:
    """The reply that an example of chat_examples() trains, as it was before it was formatted."""
    return template.plain(F.substring(F.col("text"), F.col("loss_start") + 1, F.col("loss_chars")))


#: A conversation of control strings that the query adds (fixed values of the contract).
PROBE = "SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(turn, role)"


def op12_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    made = chat_examples(turns.unionByName(spark.sql(PROBE)))
    whole = made.groupBy("conv_id").agg(
        F.max(F.when(F.col("last"), F.col("text"))).alias("text"), F.sum(F.length("text")).alias("formatted_chars"),
        F.sort_array(F.collect_list(F.when(F.col("trained"), F.struct("example", reply_of().alias("reply"))))).alias("replies"),
    )
    back = whole.select("conv_id", "formatted_chars", turns_of(F.col("text")).alias("turns"), F.array_join(F.col("replies.reply"), "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), p AS (
  SELECT *, 13 + length(role) + length(text) + len(regexp_extract_all(role, '[<\[]\\*(s>|/s>|INST\]|/INST\])')) + len(regexp_extract_all(text, '[<\[]\\*(s>|/s>|INST\]|/INST\])')) AS chars FROM c
), s AS (
  SELECT *, sum(chars) OVER w AS so_far, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS from_end FROM p
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(so_far) FILTER (role = 'assistant' OR from_end = 1) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""
