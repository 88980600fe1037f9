"""Operator 11, fill-in-middle: a text is cut in prefix, middle and suffix by operations on big integers.

One bit stands for one byte of the text. `bytes.translate` turns bytes to the digits of a class mask, shifted masks are combined
to mark where units begin and where sentinels stand, `bit_count` gives the number of units, and the place of the k-th unit is
found by halving the mask again and again, keeping the half that holds it. All of it is linear in a text's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, texts_of

#: Marks of prefix, suffix and middle (fixed values of the contract).
SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes of output that a task holds before it sends them on.
SEND_BYTES = 1 << 23


def _class(*members: int) -> bytes:
    """The translation of bytes to the digit 1 for members of a class, else 0."""
    return bytes(49 if b in members else 48 for b in range(256))


_FIRST = _class(*(b for b in range(256) if b & 0xC0 != 0x80))  # first bytes of code points
_INK = _class(*(b for b in range(256) if b not in b" \t\n\x0b\x0c\r"))
_NEWLINE = _class(10)


def mask(data: bytes, digits: bytes) -> int:
    """Bit i is set where byte i belongs to the class."""
    return int(data[::-1].translate(digits), 2) if data else 0


def unit_starts(data: bytes, unit: str) -> int:
    """Bit i is set where a unit begins: a code point (`char`), a word with the space after it (`word`), or a line with its end (`line`)."""
    if unit == "char":
        return mask(data, _FIRST)
    if unit == "word":
        ink = mask(data, _INK)
        return ink & ~(ink << 1) | bool(data)  # space before the first word is a unit of its own
    if unit == "line":
        return (mask(data, _NEWLINE) << 1 | bool(data)) & ((1 << len(data)) - 1)
    raise ValueError(f"unknown unit {unit}")


def holds(data: bytes, word: bytes) -> bool:
    """Whether the word occurs: the mask of each of its bytes, shifted back to the word's first, has a bit in common with all others."""
    found = mask(data, _class(word[0]))
    for i in range(1, len(word)):
        if not found:
            return False
        found &= mask(data, _class(word[i])) >> i
    return found != 0


def select(bits: int, width: int, k: int) -> int:
    """The place of the k-th set bit, from 0, of a mask of `width` bits; width where there are only k."""
    if k >= bits.bit_count():
        return width
    at = 0
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        n = low.bit_count()
        if k < n:
            bits, width = low, half
        else:
            bits, width, at, k = bits >> half, width - half, at + half, k - n
    return at


def fill_in_middle(docs: DataFrame, rate: int = 90, spm_rate: int = 20, seed: int = 1, unit: str = "char", sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (units; null if plain) and output of every whole text.

    The first four 8-digit groups of sha256(`seed:doc_id`) decide: cuts after h1 % (n + 1) and h2 % (n + 1) units, the form is
    plain from h3 % 100 = rate on, else spm under h4 % 100 = spm_rate, else psm. sentinels are those of prefix, suffix and
    middle; a text with one of them, or an empty one, stays plain, so restored() has one reading. Each begins with a sign that
    none has elsewhere.

    Null text counts as empty, and a null doc_id as no digits. Repeated rows are cut each, and alike. An empty table gives no
    rows; extra columns, of whatever name, stay out. Very long texts are cut whole: a mask takes an eighth of their bytes. There
    are no ties: equal cuts leave an empty middle. A row is worked on alone, so no key is hot and nothing is shuffled.
    """
    if len(set(sentinels)) != 3 or any(s[:1] != sentinels[0][:1] or sentinels[0][:1] in s[1:] or len(s) < 2 for s in sentinels):
        raise ValueError("sentinels must be three, begin alike and not have that sign again")
    if unit not in ("char", "word", "line"):
        raise ValueError(f"unknown unit {unit}")
    small_batches(docs.sparkSession)
    p_mark, s_mark, m_mark = marks = [s.encode() for s in sentinels]
    fields = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())]

    def cut(data: bytes, h1: int, h2: int, h3: int, h4: int) -> tuple:
        starts = unit_starts(data, unit)
        n = starts.bit_count()
        if not data or h3 % 100 >= rate or any(holds(data, m) for m in marks):
            return n, "plain", None, None, data
        first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = select(starts, len(data), first), select(starts, len(data), last)
        if h4 % 100 < spm_rate:
            return n, "spm", first, last - first, b"".join((s_mark, data[b:], p_mark, data[:a], m_mark, data[a:b]))
        return n, "psm", first, last - first, b"".join((p_mark, data[:a], s_mark, data[b:], m_mark, data[a:b]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [name for name, _ in fields])

        for batch in batches:
            numbers = zip(*(batch[f"h{i}"].to_pylist() for i in range(1, 5)), strict=True)
            for doc_id, text, h in zip(batch["doc_id"].to_pylist(), batch["text"], numbers, strict=True):
                rows.append((doc_id, *cut(text.as_py(), *h)))
                size += len(rows[-1][-1])
                if size >= SEND_BYTES:
                    yield sent()
                    rows, size = [], 0
        if rows:
            yield sent()

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    texts = texts_of(docs).select("doc_id", F.col("text").cast("binary").alias("text"), *numbers)
    made = texts.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return made.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that fill_in_middle() made an output of, from the output and its form alone."""
    p_mark, s_mark, m_mark = sentinels

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substring(output, F.lit(len(first) + 1), F.length(output))
        one = F.substring_index(rest, second, 1)
        rest = F.substring(rest, F.length(one) + len(second) + 1, F.length(output))
        two = F.substring_index(rest, m_mark, 1)
        return one, two, F.substring(rest, F.length(two) + len(m_mark) + 1, F.length(output))

    prefix, suffix, middle = parts(p_mark, s_mark)
    suffix_, prefix_, middle_ = parts(s_mark, p_mark)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_, middle_, suffix_))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(table(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


ORACLE = """
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents
), k AS (
  SELECT doc_id, t, n, CAST('0x' || substr(x, 1, 8) AS BIGINT) % (n + 1) AS c1, CAST('0x' || substr(x, 9, 8) AS BIGINT) % (n + 1) AS c2,
         CAST('0x' || substr(x, 17, 8) AS BIGINT) % 100 AS c3, CAST('0x' || substr(x, 25, 8) AS BIGINT) % 100 AS c4 FROM h
), f AS (
  SELECT *, CAST(least(c1, c2) AS BIGINT) AS a, CAST(greatest(c1, c2) AS BIGINT) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c3 >= 90 THEN 'plain' WHEN c4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k
), p AS (
  SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM f
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p
"""
