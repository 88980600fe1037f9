"""The corpus pipeline: documents through five operators, each stage written and read again.

Every stage carries a document's columns as one struct where it adds its own, so no name of the input can clash. An empty table
gives an empty one, null text counts as empty, and extra columns travel unchanged up to the mixture. A stage's result must be
written before the next stage begins, which first frees the tables that the one before it has left in the shared folder.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm.common import durable, free, keeping, table
from skeinwork.llm.decontaminate import without_passages
from skeinwork.llm.mixing import mix, mixture
from skeinwork.llm.ngram_join import components
from skeinwork.llm.quality import quality_rules
from skeinwork.llm.token_output import token_files


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: What the operators of the last stage have left in the shared folder.
_left: list[str] = []


def _stage(f: Stage) -> Stage:
    """A stage that first frees what the one before it has left, as its result is written by now, and notes what it leaves itself."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        free(spark, _left)
        with keeping(_left):
            return f(spark, docs, sf_dir)

    return run_stage


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows of the doc_ids in gone (gone); rows of one doc_id go or stay together, rows without one stay.

    gone grows with the corpus, so it is never broadcast: the two are merged by doc_id at every size.
    """
    return docs.select(F.struct(*docs.columns).alias("row")).join(gone.hint("merge"), F.col("row.doc_id") == F.col("gone"), "left_anti").select("row.*")


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: null, empty and short texts go. Repeated rows are judged each, and alike."""
    return quality_rules(docs, table(spark, sf_dir, "labels")).filter("kept").select("row.*")


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component of near duplicates; empty texts have none and stay.

    Rows without a doc_id stay, as do repeated rows of the doc_id that stays. A doc_id with several texts goes with all of its
    rows if one of them has an earlier near duplicate.
    """
    later = components(docs).filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("gone"))
    return _without(docs, later)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. The verdict is on the text: repeated rows share it, null and empty texts stay."""
    return without_passages(docs, table(spark, sf_dir, "benchmark"))


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture asks for. Rates are 1 at least, so the mixture raises domains and loses no document."""
    return mixture(mix(docs, table(spark, sf_dir, "labels"), least=1.0))


@_stage
def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture, and what they hold of each document: copies are written each, null doc_ids first."""
    return token_files(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: The quality verdict and the mixture come from fitted models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        written: list[str] = []
        with keeping(written):
            docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
        free(spark, before)
        before = written
    return docs
