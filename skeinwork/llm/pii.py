"""Operator 10, personal data: base patterns, and terms that disclose them by corpus co-occurrence. DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, durable, table, text_key

#: The contract's patterns, written so that Java's matcher needs no backtracking, recursion or rescanning; they find the
#: same leftmost matches. A run of digits and single separators is one card match, so only runs of 16 to 19 digits count.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Protected besides the contract's kinds: runs of 20 or more letters, digits and _ with a letter and three digits, as keys have.
SECRET = r"(?<![A-Za-z0-9_])(?=[0-9_]*+[A-Za-z])(?=(?:[A-Za-z_]*+[0-9]){3})[A-Za-z0-9_]{20,}+"
KINDS = (*PATTERNS, "secret", "term")
IP_PARTS = r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"
SPAN = "array<struct<k:int,s:int,e:int,v:string>>"


def _found(text: Column, pattern: str | Column, k: int, keep) -> Column:
    """Spans of the matches that keep() accepts: what lies between the matches gives their places, in code points."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(F.lit(k).alias("k"), start.alias("s"), end.alias("e"), x["hit"].alias("v"))
        return F.struct(end.alias("at"), F.when(x["hit"].isNotNull() & keep(x["hit"]), F.concat(acc["got"], F.array(span))).otherwise(acc["got"]).alias("got"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("got"))
    return F.when(F.rlike(text, pattern), F.aggregate(parts, begin, step, lambda a: a["got"])).otherwise(F.array().cast(SPAN))


def _luhn(value: Column) -> Column:
    digits = F.split(F.reverse(F.translate(value, " -", "")), "")
    doubled = F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: F.when(i % 2 == 1, 2 * d.cast("int")).otherwise(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def base_spans(text: Column) -> Column:
    """All base spans of a text as array<struct<k,s,e,v>>: k counts KINDS, s and e are code points, v is the matched text."""
    keep = {
        "email": lambda v: F.lit(True),
        "ip": lambda v: v.rlike(IP_PARTS),
        "card": _luhn,
        "phone": lambda v: F.length(F.regexp_replace(v, "[^0-9]", "")).between(8, 15),
    }
    guard = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9]"), "phone": F.contains(text, F.lit("+"))}
    none = F.array().cast(SPAN)
    return F.concat(*[F.when(guard[kind], _found(text, pattern, k, keep[kind])).otherwise(none) for k, (kind, pattern) in enumerate(PATTERNS.items())])


def _words(text: Column) -> Column:
    """The distinct words of three letters and more, in lower case."""
    return F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+")), lambda w: F.length(w) >= 3)


def disclosing_terms(texts: DataFrame, entities: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(entity, term, disclosure): terms that give away at least `threshold` of an entity's information.

    disclosure = ln((co - 1) N / (df(entity) df(term))) / ln(N / df(entity)): the pair's pointwise mutual information over the
    entity's information. All counts are over distinct texts, whole ones, so copies are no evidence; one text is taken off co, as
    a single meeting says nothing of either. That a term is in so many texts with any entity bounds df(term) from below: pairs
    that fail with the bound can never pass and are dropped before the words of all texts are counted.
    """
    n = texts.agg(F.count("*").alias("n"))
    df_entity = entities.groupBy("entity").agg(F.count("*").alias("df_entity"))
    inside = pairs.select("tkey", "term").distinct().groupBy("term").agg(F.count("*").alias("inside"))
    met = pairs.groupBy("entity", "term").agg(F.count("*").alias("co")).filter("co > 1").join(df_entity, "entity").join(inside, "term").withColumn("n", n.scalar())

    def disclosure(df_term: str) -> Column:
        information = F.log(F.col("n") / F.col("df_entity"))
        return F.when(information > 0, F.log((F.col("co") - 1) * F.col("n") / (F.col("df_entity") * F.col(df_term))) / information)

    met = met.withColumn("most", disclosure("inside")).filter(F.col("most") >= threshold)
    counted = texts.select(F.explode(_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df_term"))
    return met.join(counted, "term").withColumn("disclosure", disclosure("df_term")).filter(F.col("disclosure") >= threshold).select("entity", "term", "disclosure")


def _clean(text: Column, spans: Column) -> Column:
    """text with each span generalised to its kind in brackets; of spans that overlap, the first by start."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.sort_array(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))

    def step(acc: Column, x: Column) -> Column:
        new = F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.element_at(names, x["k"] + 1)).alias("out"), x["e"].alias("at"))
        return F.when(x["s"] >= acc["at"], new).otherwise(acc)

    whole = F.aggregate(ordered, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.lit(2**31 - 1))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def sanitise(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """tkey (see text_key), spans (array<struct<k,s,e>>, by kind, then start) and clean, of every distinct text that holds a span.

    Base spans always stay, and so do secrets. Entities are the spans' lower-case values by kind, and the hosts of addresses. A word anywhere in a text that
    holds an entity becomes spans of kind "term", each time it stands there outside other spans, where it discloses that entity
    (see disclosing_terms). clean is the text with every span generalised to its kind. Null and empty texts hold none;
    repeated rows are one text; an empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    text = F.coalesce(F.col("text"), F.lit(""))
    secret = F.when(F.col("text").rlike("[A-Za-z0-9_]{20}"), _found(F.col("text"), SECRET, KINDS.index("secret"), lambda v: F.lit(True))).otherwise(F.array().cast(SPAN))
    texts = docs.select(text_key(text).alias("tkey"), text.alias("text")).dropDuplicates(["tkey"])
    texts = scratch.write(texts.withColumn("spans", F.concat(base_spans(F.col("text")), secret)), "texts")
    found = texts.filter(F.size("spans") > 0)  # from here on no text without a span is shuffled
    value, host = F.concat_ws(":", F.col("x.k").cast("string"), F.lower("x.v")), F.concat(F.lit("host:"), F.lower(F.substring_index("x.v", "@", -1)))
    named = F.when(F.col("x.k") == KINDS.index("email"), F.array(value, host)).otherwise(F.array(value))
    entities = found.select("tkey", F.explode("spans").alias("x")).select("tkey", F.explode(named).alias("entity")).distinct()
    # an entity of one text meets every word of it once, which says nothing: the pairs of others alone are made
    several = entities.groupBy("entity").agg(F.count("*").alias("df")).filter("df > 1").select("entity")
    entities = scratch.write(entities.join(several, "entity"), "entities")
    inside = found.join(entities.select("tkey").distinct(), "tkey", "left_semi").select("tkey", F.explode(_words(F.col("text"))).alias("term"))
    pairs = scratch.write(inside.join(entities, "tkey").select("tkey", "entity", "term"), "pairs")
    bad = scratch.write(disclosing_terms(texts, entities, pairs, threshold), "terms")
    terms = scratch.write(pairs.join(bad.select("entity", "term"), ["entity", "term"], "left_semi").groupBy("tkey").agg(F.collect_set("term").alias("terms")), "hits")
    rows = found.join(terms, "tkey", "left")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("terms", "|"), F.lit(r")(?!\p{L})"))
    hits = F.when(F.size("terms") > 0, _found(F.col("text"), pattern, KINDS.index("term"), lambda v: F.lit(True))).otherwise(F.array().cast(SPAN))
    free = F.filter(hits, lambda w: ~F.exists(F.col("spans"), lambda b: (b["s"] < w["e"]) & (b["e"] > w["s"])))
    rows = rows.select("tkey", "text", F.transform(F.concat("spans", free), lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))).alias("spans"))
    out = durable(rows.select("tkey", "spans", _clean(F.col("text"), F.col("spans")).alias("clean")), "pii-clean")
    scratch.drop()
    return out


def redact(docs: DataFrame, clean: DataFrame) -> DataFrame:
    """docs with the clean texts that sanitise() gives; null texts stay null, all other texts and columns as they are."""
    rows = docs.select(F.struct(*docs.columns).alias("row")).join(clean.select("tkey", "clean"), text_key("row.text") == F.col("tkey"), "left")
    return rows.select(*[F.coalesce("clean", "row.text").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op10_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base kinds, and besides n_secret, n_term, n_spans (of all kinds) and clean_sha256 of the sanitised text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    base = F.filter("spans", lambda x: x["k"] < len(PATTERNS))
    each = sanitise(docs).select(
        "tkey", *[count(k) for k in range(len(KINDS))], F.size("spans").cast("long").alias("n_spans"), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"), F.sha2(F.col("clean").cast("binary"), 256).alias("clean_sha256"),
    )
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text_key(text).alias("tkey"), F.sha2(text.cast("binary"), 256).alias("same")).join(each, "tkey", "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in (*[f"n_{k}" for k in KINDS], "n_spans")]
    lines = F.coalesce("base_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans")
    return rows.select("doc_id", *counts[: len(PATTERNS)], *lines, *counts[len(PATTERNS) :], F.coalesce("clean_sha256", "same").alias("clean_sha256"))
