"""The corpus operators against brute force on small tables, with nulls, empty texts, repeated rows and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skeinwork.llm import decontaminate, mixing, ngram_join, pii, quality, queries, suffix_dedup, token_counts, token_output, toxicity, vocab, warc

PASSAGE = "the quick brown fox jumps over the lazy dog near the river bank while seven small birds sing above old stones"
ODD = [
    (1, PASSAGE + " alpha beta"), (2, "gamma " + PASSAGE), (3, PASSAGE + " alpha beta"), (4, None), (5, ""), (6, "one two"), (7, "ONE two"),
    (8, "z" * 300), (9, "z" * 120 + "y"), (10, "é" * 40 + " ünï\x00 end"), (11, "\n \t"), (3, PASSAGE + " alpha beta"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("h", F.lit("x")).withColumn("row", F.lit(1)).withColumn("bucket", F.lit(2))


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def removed(rows):
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for a in range(len(b) - 49):
            first.setdefault(b[a : a + 50], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for a in range(len(b) - 49):
            if first[b[a : a + 50]] < i:
                gone[a : a + 50] = b"\1" * 50
        spans = sum(1 for a, g in enumerate(gone) if g and not (a and gone[a - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_suffix_dedup(which, request):
    docs = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, suffix_dedup.remove_repeats(docs).collect())) == removed(rows)


def linked(rows):
    low, sets = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)}), []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append((i, frozenset(tuple(w[a : a + 5]) for a in range(max(len(w) - 4, 1))) if w else frozenset()))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i < j and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets)


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_ngram_join(which, request):
    docs = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, ngram_join.components(docs).collect())) == linked(rows)


def test_ngram_join_over_65536_shingles(spark):
    words = [f"w{i}" for i in range(70_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-1])), (3, " ".join(words[:20_000])), (4, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.components(docs).collect())) == [(1, 69_996, 1), (2, 69_995, 1), (3, 19_996, 3), (4, 1, 4)]


def test_tokens(spark, odd, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    docs = odd.filter("doc_id != 3")
    rows = sorted((r.doc_id, tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect())
    counted = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, path).collect()}
    assert counted == {i: len(ids) for i, ids in rows}
    want, start = [], 0
    for i, ids in rows:
        ids = [*ids, 1]
        want.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    assert sorted(map(tuple, token_output.token_files(docs, path).collect())) == want


def test_decontaminate(spark):
    words = PASSAGE.split()
    changed = " ".join(["intro"] * 5 + words[:6] + ["other"] + words[7:] + ["outro"] * 5)
    docs = spark.createDataFrame([(1, "before " + PASSAGE), (2, changed), (3, "nothing of the kind here at all"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(9, PASSAGE), (10, None)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contaminated(docs, items).collect()} == {1, 2}


def test_decontaminate_passage_before_a_poorer_stretch(spark):
    item = [f"w{i}" for i in range(64)]
    copy = [w if i < 12 or i % 4 else f"x{i}" for i, w in enumerate(item)]
    poor = [w if i % 3 else f"x{i}" for i, w in enumerate(item)]
    docs = spark.createDataFrame([(1, " ".join(["before", *copy])), (2, " ".join(poor))], "doc_id long, text string")
    found = decontaminate.contaminated(docs, spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")).collect()
    assert [tuple(r) for r in found] == [(1, 9, 12, 12, 1)]


def test_quality_and_pii_and_toxicity(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.quality_rules(odd, labels).count() == len(ODD)
    assert quality.quality_rules(odd, labels).filter("not base_failed and n_dup_lines = 0 and score < 99").count() == 0
    assert toxicity.toxicity(odd, labels).count() == len(ODD)
    assert mixing.mix(odd.select("doc_id", "text", F.lit("en").alias("lang")), labels).count() == len(ODD)
    text = spark.createDataFrame([(1, "mail a@b.co, ip 10.0.0.1, card 4111 1111 1111 1111, tel +44 20 7946 0958")], "doc_id long, text string")
    spans = pii.sanitise(text).first().spans
    assert [s.k for s in spans] == [0, 1, 2, 3]


def test_quality_scores_leave_the_document_out(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (9, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    buckets = 64
    rows = [(r.doc_id, list(r.f)) for r in quality.base_rules(odd).select("row.doc_id", quality._features(F.col("h"), buckets).alias("f")).collect()]
    want = []
    for k, (i, f) in enumerate(rows):
        rest = [x for j, x in enumerate(rows) if j != k]
        raw, good = Counter(b for _, g in rest for b in g), Counter(b for j, g in rest if j in (1, 9) for b in g)
        p_raw = {b: (raw[b] + 1) / (raw.total() + buckets) for b in f}
        want.append((i, sum(math.log((good[b] + buckets * p_raw[b]) / (good.total() + buckets) / p_raw[b]) for b in f) / len(f) if f else 0.0))
    got = sorted((r[0], r.score) for r in quality.quality_rules(odd, labels, buckets=buckets).select("row.doc_id", "score").collect())
    assert [i for i, _ in got] == sorted(i for i, _ in want)
    assert [x for _, x in got] == pytest.approx([x for _, x in sorted(want)])


def test_quality_takes_every_label(spark):
    """All labelled documents count, each once: no number of them is left out, and one of both qualities is good."""
    labels = spark.range(120_000).selectExpr("id AS doc_id", "CAST(id % 4 > 0 AS INT) AS quality").unionByName(spark.createDataFrame([(0, 1), (4, None), (None, 1), (5, 1)], "doc_id long, quality int"))
    known = {r.quality: r.n for r in quality._known(labels).groupBy("quality").agg(F.count("*").alias("n")).collect()}
    assert known == {0: 29_999, 1: 90_001}
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("text"))
    counts = quality.bucket_counts(docs, quality._known(spark.range(60_000).selectExpr("id AS doc_id", "1 AS quality")), 1024).agg(F.sum("raw"), F.sum("good")).first()
    assert tuple(counts) == (60_000, 60_000)


def test_quality_keeps_good_documents_without_a_label(spark, sf_dir, documents):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    fit = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    hidden = {r.doc_id for r in labels.join(fit, "doc_id", "left_anti").filter("quality = 1").collect()}
    judged = quality.quality_rules(documents, fit).select("row.doc_id", "base_failed", "kept").collect()
    held = [r.kept for r in judged if r.doc_id in hidden and not r.base_failed]
    assert len(held) > 20 and sum(held) >= 0.9 * len(held)


def test_warc_files(spark, sf_dir, tmp_path):
    """Real .warc.gz files, read by another gzip reader and back, with records that a long page and an empty one give."""
    import glob
    import gzip

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").limit(20).select("page_id", "url", "html")
    pages = pages.unionByName(spark.createDataFrame([(None, None, None), (7000, "http://x/", "<p>" + "long é " * 300_000), (7001, "http://y/", "")], pages.schema)).withColumn("headers", F.lit(1)).withColumn("block", F.lit("x"))
    records = warc.derive(warc.responses(pages))
    files = warc.write_warc(records.repartition(3), f"file://{tmp_path}/out", part_bytes=3_000)
    assert records.count() == 2 * pages.count() == sum(r.records for r in files.collect())
    names = sorted(glob.glob(f"{tmp_path}/out/*.warc.gz"))
    assert sorted(r.path.removeprefix("file://") for r in files.collect()) == names and len(names) > 3
    whole = b"".join(gzip.open(n).read() for n in names)
    assert whole.count(b"WARC/1.1\r\n") == records.count()
    key = lambda r: (r.headers["WARC-Record-ID"], r.block)
    back = warc.read_warc(files).collect()
    assert sorted(map(key, back)) == sorted(map(key, records.collect()))
    assert all(r.headers["Content-Length"] == str(len(r.block.encode())) for r in back)
    assert warc.write_warc(records.limit(0), f"file://{tmp_path}/none").count() == 0


def test_warc_of_others():
    """Members that hold several records, headers in other cases, pieces of any size, and a file that breaks off."""
    import gzip

    one = b"WARC/1.0\r\nwarc-type: response\r\ncontent-length: 5\r\n\r\na\r\nbc\r\n\r\n"
    two = b"WARC/1.1\r\nWARC-Type:metadata\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    data = gzip.compress(one + two) + gzip.compress(two) + gzip.compress(one)
    for size in (1, 7, 1000):
        found = list(warc.parse(iter([data[i : i + size] for i in range(0, len(data), size)])))
        assert [(h.get("warc-type") or h["WARC-Type"], b) for h, b in found] == [("response", b"a\r\nbc"), ("metadata", b""), ("metadata", b""), ("response", b"a\r\nbc")]
    assert len(list(warc.parse(iter([data[:-30]])))) == 3


def test_plain_text(spark):
    cases = {
        '<p title="a > b">x</p><a href=\'>\'>y</a>': "x\ny", "1 < 2 &amp;&amp; 3 &gt; 2": "1 < 2 && 3 > 2", "&eacute;&#233;&#xE9;&nbsp;&euro;&hellip;&#128;": "éé" + "é €…€", "&amp;lt; &unknown; &#39;": "&lt; &unknown; '",
        "<script>var t='</p>'</script>a<style>b</style ><!-- <p> -->c": "a c", '<a href="open>text</a>': "text", "": "", "<br/><br>\n\n z \t z": "z z", "&#0;&#xD800;": "\ufffd\ufffd",
    }
    got = {r.h: r.t for r in spark.createDataFrame([(c,) for c in cases], "h string").select("h", warc.plain_text(F.col("h")).alias("t")).collect()}
    assert got == cases


def test_sequence_of_a_shard_with_long_documents(tmp_path):
    length, kind = 2048, pa.uint16()
    shard = token_output._Shard(f"file://{tmp_path}/shard.arrow", length, kind)
    sizes = np.array([token_output.BATCH * length - 10, 7_000, 3, 600_000, 2_049, 1_200_000, 5_000])
    ids = np.random.default_rng(1).integers(2, 49_000, sizes.sum()).astype(np.uint16)
    for part in (slice(0, 1), slice(1, 4), slice(4, 7)):
        shard.add(list(range(7))[part], ids[sizes[: part.start].sum() : sizes[: part.stop].sum()], sizes[part])
    shard.close()
    n = -(-len(ids) // length)
    for k in range(n):
        want = ids[k * length : (k + 1) * length]
        got, mask = token_output.sequence(shard.path, k)
        assert not got.flags.owndata and not mask.flags.owndata  # views of the file
        mask = token_output.unpack_mask(mask)
        assert len(got) == len(mask) == length and mask.sum() == len(want)
        assert (got[: len(want)] == want).all() and not got[len(want) :].any() and mask[: len(want)].all()
    with pytest.raises(IndexError):
        token_output.sequence(shard.path, n)


@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op2_ngram_join", "op3_token_output", "op4_decontaminate", "op6_mixing", "op7_token_counts", "op8_quality_rules", "op9_toxicity", "op10_disclosure"])
def test_empty_tables(spark, sf_dir, name, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.queries()[name](spark, str(tmp_path)).count() == 0


def clustered(spark, seed, bases, copies, share, words=120):
    """Documents about bases: copies with `share` of the words changed, so that many pairs lie about the limit."""
    rng = np.random.default_rng(seed)
    rows = []
    for b in range(bases):
        base = [f"b{b}w{i}" for i in range(words)]
        for _ in range(copies):
            gone = rng.random(words) < share
            rows.append((len(rows), " ".join(f"x{rng.integers(40)}" if g else w for w, g in zip(base, gone, strict=True))))
    return rows


@pytest.mark.parametrize("share", [0.01, 0.03, 0.05])
def test_ngram_join_of_groups_about_the_limit(spark, share, monkeypatch):
    rows = clustered(spark, 3, 4, 25, share) + [(1000 + i, f"common passage of some ten words that all of these have {i} own{i}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = linked(rows)
    assert sorted(map(tuple, ngram_join.components(docs).collect())) == want
    # the same where shingles count as frequent from two sets on, and where clusters are split into blocks
    monkeypatch.setattr(ngram_join, "RARE", 1)
    monkeypatch.setattr(ngram_join, "CLUSTER_SETS", 7)
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 4000)
    assert sorted(map(tuple, ngram_join.components(docs).collect())) == want


def test_vocabulary_cuts_as_the_library(spark, sf_dir):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    vocabulary = vocab.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["", " ", "'", "it's", "'s", "''s", "don't'll", "we'RE 'r 'v 'vex 'l 'll'd", "a'", "'t", "x²3½ 12'34", "¡Hola! niño's straße", "a\tb\r\nc", "end's"]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + ["x" * 300_000, "日本語 text", "<|endoftext|> b"]
    ids, sizes = vocabulary.encode(texts)
    parts = np.split(ids, np.cumsum(sizes)[:-1])
    for text, part in zip(texts, parts, strict=True):
        assert part.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text[:80]


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    def luhn(d):
        return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    out = {k: [] for k in BASE}
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out[kind].append((m.start(), m.end()))
    return out


def test_disclosure_base_spans_and_terms(spark, tmp_path, sf_dir):
    odd = ["", None, "a@b.co.", "1.2.3.4.5 and 999.1.1.1 x1.2.3.4", "4111-1111-1111-1111 4111 1111 1111 1112", "+1 (415) 555-2671, +12", "é a@b.c-d.e ü", "key 0123456789abcdef0123456789abcdef", "a@b.co"]
    held = [f"write to jane.doe@corp.example about the zorblat matter number {w}" for w in ("one", "two", "three")]
    other = [f"nothing to see about the matter number {i} {i * 7919}" for i in range(60)]
    texts = odd + held + held[:1] * 40 + other + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("spans", F.lit(2))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in pii.op10_disclosure(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = base_spans(text or "")
        line = ",".join(f"{k}:{a}:{b}" for k in BASE for a, b in want[k])
        assert [got[i][f"n_{k}"] for k in BASE] == [len(want[k]) for k in BASE], text
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert got[i].spans.startswith(line)
    at = held[0].index("zorblat")
    assert f"term:{at}:{at + 7}" in got[len(odd)].spans  # the word that only texts with that address have
    assert "term" not in got[len(odd) + len(held) + 41].spans and got[7].n_secret == 1
    clean = {r.doc_id: r.text for r in pii.redact(docs, pii.sanitise(docs)).select("doc_id", "text").collect()}
    assert "jane" not in clean[len(odd)] and "zorblat" not in clean[len(odd)] and clean[1] is None and clean[8] == "[EMAIL]"


def test_mixture_meets_its_targets_and_keeps_clashing_names(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", F.lit(7).alias("n"), F.lit(0.5).alias("rate"), F.lit(1).alias("p"), F.lit(3).alias("copies"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    want = {"de": 0.25, "en": 0.25, "es": 0.25, "fr": 0.25}
    for least in (0.0, 1.0):
        mixed = mixing.mix(docs, labels, weights=want, least=least).collect()
        total = sum(np.array(r.p) * r.n_tokens * r.rate for r in mixed)
        assert total / total.sum() == pytest.approx([0.25] * 4, abs=1e-4)
        assert min(r.rate for r in mixed) >= least
        assert {tuple(r.row)[3:] for r in mixed} == {(7, 0.5, 1, 3)}


def test_decontaminate_finds_substituted_short_and_unnamed(spark):
    rng = np.random.default_rng(5)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(60))) for i in range(20)] + [(50, "seven words of an item stand here"), (51, "the")]
    rows, sure = [], set()
    for i in range(200):
        words = items[i % 20][1].split()
        gone = rng.random(60) < (0.0, 0.1, 0.15)[i % 3]
        rows.append((i, " ".join([f"a{rng.integers(99)}" for _ in range(30)] + [f"s{rng.integers(999)}" if g else w for w, g in zip(words, gone, strict=True)])))
        best = max(int((~gone[a : a + 12]).sum()) for a in range(49))
        sure |= {i} if best >= 11 else set()
    rows += [(300, "we say: Seven words, of an item stand here!"), (301, "seven words of an item stand there"), (None, items[0][1]), (302, None), (303, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tkey", F.lit(1)).withColumn("row", F.lit(2))
    benchmark = spark.createDataFrame(items[:-1], "item_id long, text string")
    found = {r.doc_id for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert found >= sure | {300, None} and not found & {301, 302, 303}
    kept = {r.doc_id for r in decontaminate.without_passages(docs, benchmark).collect()}
    assert kept == {i for i, _ in rows} - found
    assert decontaminate.without_passages(docs, benchmark).columns == docs.columns
    assert decontaminate.contaminated(docs.limit(0), benchmark).count() == decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0
