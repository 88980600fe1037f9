"""Queries against the contracts' own words on every text of a small table, and on a table with everything odd in it."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skeinwork.llm import queries, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAMES = ["op1_suffix_dedup", "op2_ngram_join", "op3_token_output", "op4_decontaminate", "op6_mixing", "op7_token_counts", "op8_quality_rules", "op9_toxicity", "op10_disclosure", "op11_fill_in_middle", "op13_periodic_runs"]


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    """The documents of sf0.001, some of them twice, and rows with nulls, empty texts, a very long one and clashing columns."""
    at = tmp_path_factory.mktemp("odd")
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = [(None, "no id, and a text of some words"), (None, None), (9001, None), (9002, ""), (9003, " \n\t"), (9004, " ".join(f"w{i % 4001}" for i in range(60_000))), (9005, "x" * 200_000)]
    docs = real.unionByName(real.filter("doc_id < 20")).unionByName(spark.createDataFrame(odd, "doc_id long, text string"), allowMissingColumns=True)
    clash = ("row", "h", "w", "kept", "score", "block", "bucket", "sid", "tkey", "spans", "n", "n_words", "rate", "p", "words", "runs", "form", "held_out")
    docs.withColumns({c: F.lit(i) for i, c in enumerate(clash)}).repartition(5).write.parquet(f"{at}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{at}/{t}.parquet")
    return str(at)


@pytest.fixture(scope="module")
def texts(spark, folder):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", NAMES)
def test_every_row_of_an_odd_table_has_its_result(spark, folder, texts, name):
    got = queries.queries()[name](spark, folder)
    ids = Counter(r.doc_id for r in got.select("doc_id").collect())
    if name == "op4_decontaminate":
        assert set(ids) <= {i for i, _ in texts}
    else:
        assert ids == Counter(i for i, _ in texts)


def base_columns(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(repeated), n < 50 or 100 * len(repeated) > 50 * n


def test_quality_base_columns(spark, folder, texts):
    got = queries.queries()["op8_quality_rules"](spark, folder).collect()
    rows = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert rows == Counter((i, *base_columns(t)) for i, t in texts)
    assert not [r for r in got if r.base_failed and r.kept]


def test_token_counts_and_files_of_all_texts(spark, folder, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encoded = [(i, t, tokenizer.encode(t, add_special_tokens=False).ids) for i, t in texts]
    counts = queries.queries()["op7_token_counts"](spark, folder).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in counts) == Counter((i, len(t.encode()), len(x), len(x) > 2048) for i, t, x in encoded)
    files = queries.queries()["op3_token_output"](spark, folder).collect()
    crc = lambda x: zlib.crc32(b"".join(n.to_bytes(4, "little") for n in [*x, 1]))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in files) == Counter((i, len(x) + 1, crc(x)) for i, _, x in encoded)
    # ascending doc_id, null first; rows of one id follow one another in any order
    start = 0
    for r in sorted(files, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    order = [r.doc_id for r in sorted(files, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))


def test_label_model_finds_what_voters_are_worth():
    """Posteriors of independent voters near those of Bayes with the true rates, and a voter that is repeated counts about once."""
    rng = np.random.default_rng(3)
    n, prior = 4000, 0.2
    label = rng.random(n) < prior
    sens, fals = np.array([0.7, 0.5, 0.4, 0.6, 0.3]), np.array([0.05, 0.02, 0.1, 0.2, 0.01])
    votes = rng.random((n, 5)) < np.where(label[:, None], sens, fals)
    row, voter = np.nonzero(votes)
    post = toxicity.label_model(row, voter, n, np.full(5, 0.4), np.full(5, 0.1), prior, 5)
    z = np.log(prior / (1 - prior)) + np.where(votes, np.log(sens / fals), np.log((1 - sens) / (1 - fals))).sum(1)
    true = 1 / (1 + np.exp(-z))
    assert abs(post.mean() - prior) < 0.01 and np.corrcoef(post, true)[0, 1] > 0.9
    # the first voter ten times over: its hits alone must not settle a row that the others do not support
    row10, voter10 = np.concatenate([row, np.repeat(row[voter == 0], 10)]), np.concatenate([voter, np.tile(np.arange(5, 15), int((voter == 0).sum()))])
    many = toxicity.label_model(row10, voter10, n, np.full(15, 0.4), np.full(15, 0.1), prior, 15)
    assert np.corrcoef(many, true)[0, 1] > 0.85
    alone = votes[:, 0] & ~votes[:, 1:].any(1)
    assert abs(many[alone].mean() - post[alone].mean()) < 0.25
