"""The subpackage's named queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_examples, fill_in_middle, warc
from .decontaminate import op4_decontaminate
from .mixing import op6_mixing
from .ngram_join import op2_ngram_join
from .periodic_runs import op13_periodic_runs
from .pii import op10_disclosure
from .quality import op8_quality_rules
from .suffix_dedup import op1_suffix_dedup
from .token_counts import op7_token_counts
from .token_output import op3_token_output
from .toxicity import op9_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_ngram_join": op2_ngram_join,
        "op3_token_output": op3_token_output,
        "op4_decontaminate": op4_decontaminate,
        "op5_warc_derivatives": warc.op5_warc_derivatives,
        "op6_mixing": op6_mixing,
        "op7_token_counts": op7_token_counts,
        "op8_quality_rules": op8_quality_rules,
        "op9_toxicity": op9_toxicity,
        "op10_disclosure": op10_disclosure,
        "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
        "op12_chat_examples": chat_examples.op12_chat_examples,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_warc_derivatives": warc.ORACLE,
        "op11_fill_in_middle": fill_in_middle.ORACLE,
        "op12_chat_examples": chat_examples.ORACLE,
    }
