"""The pipeline stage by stage against the operators' own rules, on an odd table, an empty one, and for what it leaves behind."""

import os
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from skeinwork.llm import decontaminate, ngram_join, quality


def staged(spark, folder, tmp_path):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), [spark.read.parquet(f"{folder}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        out.append(docs)
    return out


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    return staged(spark, sf_dir, tmp_path_factory.mktemp("stages"))


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_do_what_their_operators_say(spark, sf_dir, stages):
    documents, good, apart, clean, mixed, tokens = stages
    for df in (good, apart, clean, mixed):
        assert df.columns == documents.columns
    verdicts = quality.quality_rules(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("row.doc_id", "kept").collect()
    assert ids(good) == sorted(r.doc_id for r in verdicts if r.kept)
    assert ids(apart) == sorted(r.doc_id for r in ngram_join.components(good).collect() if r.doc_id == r.component_id)
    found = {r.doc_id for r in decontaminate.contaminated(apart, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert ids(clean) == [i for i in ids(apart) if i not in found] and found
    assert set(ids(mixed)) == set(ids(clean))  # every document at least once
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = [], 0
    for r in sorted(mixed.collect(), key=lambda r: r.doc_id):
        n = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.append((r.doc_id, start, len(n), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in n))))
        start += len(n)
    assert sorted(tuple(r) for r in tokens.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


def test_run_gives_the_stages_rows_and_leaves_its_last_table_alone(spark, sf_dir, stages):
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/skeinwork"
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    got = corpus_pipeline.run(spark, sf_dir)
    left = {n for n in set(os.listdir(shared)) - before if not n.startswith("stage-token_output")}
    assert not [n for n in left if n.startswith(("stage-", "quality-judged", "join-", "passages-found"))], left
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[-1].collect()))


def test_an_odd_table(spark, sf_dir, tmp_path):
    """Null ids and texts, empty and long ones, repeated rows and clashing columns end in no crash, and no clean document is lost."""
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clash = {c: F.lit(i) for i, c in enumerate(("row", "kept", "gone", "tkey", "n", "rate", "p", "copies", "bucket", "block"))}
    some = real.filter("doc_id < 60")
    odd = spark.createDataFrame([(None, "no id at all"), (None, None), (901, None), (902, ""), (903, " ".join(f"word{i % 977}" for i in range(80_000)))], "doc_id long, text string")
    docs = some.unionByName(some.filter("doc_id < 9")).unionByName(odd, allowMissingColumns=True).withColumns(clash)
    folder = f"{tmp_path}/in"
    docs.write.parquet(f"{folder}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    documents, good, *_, mixed, tokens = staged(spark, folder, tmp_path)
    assert mixed.columns == documents.columns and good.count() > 20
    assert tokens.count() == mixed.count() > 0


def test_empty_tables(spark, sf_dir, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/in/{t}.parquet")
    assert [df.count() for df in staged(spark, f"{tmp_path}/in", tmp_path)] == [0] * 6
