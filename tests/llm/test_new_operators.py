"""Operators 11 to 13 against SQL and brute force: every text of a small table, and texts made to be awkward."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from skeinwork.llm import chat_examples, fill_in_middle, periodic_runs, queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def against_sql(spark, folder, name):
    db = duckdb.connect()
    for t in ("documents", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = db.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = queries.queries()[name](spark, folder)
    assert sorted(got.columns) == sorted(columns)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=key) == sorted(want.fetchall(), key=key)


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_chat_examples"])
def test_query_matches_sql(spark, sf_dir, name):
    against_sql(spark, sf_dir, name)


TEXTS = [None, "", "a", "é", "日本語のテキスト", "🇩🇪 flags", "has <P> inside", "has <S>", "<M>", "<<P", "a<S", "S>b", "line\n\nline two\n", "  lead and trail  ", "\x00nul", "é" * 50, "x" * 300_000, "ab" * 70_000 + "é"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 6)] + [(3, "é"), (3, "é"), (None, "no id"), (None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("h1", F.lit("x")).withColumn("form", F.lit(1)).withColumn("words", F.lit(2)).withColumn("runs", F.lit(3)).repartition(3)


def test_fill_in_middle(spark, odd, tmp_path):
    rows = fill_in_middle.fill_in_middle(odd).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == odd.count()
    texts = {r.doc_id: r.text or "" for r in odd.filter("doc_id is not null").collect()}
    for r in rows:
        if r.doc_id is None:
            assert r.back in ("no id", "")
            continue
        text, digest = texts[r.doc_id], sha(f"1:{r.doc_id}")
        h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
        a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
        assert (r.n, r.back) == (len(text), text)
        if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
            assert (r.form, r.prefix_chars, r.middle_chars, r.output) == ("plain", None, None, text)
            continue
        pre, mid, suf = text[:a], text[a:b], text[b:]
        assert (r.form, r.prefix_chars, r.middle_chars) == ("spm" if h4 % 100 < 20 else "psm", a, b - a)
        assert r.output == (f"<S>{suf}<P>{pre}<M>{mid}" if h4 % 100 < 20 else f"<P>{pre}<S>{suf}<M>{mid}")
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.queries()["op11_fill_in_middle"](spark, str(tmp_path)).count() == len(rows)


@pytest.mark.parametrize("unit,cut", [("word", r"\S+\s*|^\s+"), ("line", r"[^\n]*\n|[^\n]+")])
def test_fill_in_middle_by_words_and_lines(odd, unit, cut):
    texts = {r.doc_id: r.text or "" for r in odd.filter("doc_id is not null").collect()}
    rows = fill_in_middle.fill_in_middle(odd, unit=unit, rate=100).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).filter("doc_id is not null").collect()
    for r in rows:
        units = re.findall(cut, texts[r.doc_id])
        assert (r.n, r.back) == (len(units), texts[r.doc_id])
        if r.form == "psm":
            assert r.output.startswith("<P>" + "".join(units[: r.prefix_chars]) + "<S>")
            assert r.output.endswith("<M>" + "".join(units[r.prefix_chars : r.prefix_chars + r.middle_chars]))


def test_select_and_holds():
    rng = random.Random(1)
    for _ in range(300):
        width = rng.randrange(1, 400)
        bits = rng.getrandbits(width)
        places = [i for i in range(width) if bits >> i & 1]
        assert [fill_in_middle.select(bits, width, k) for k in range(len(places) + 1)] == [*places, width]
    assert fill_in_middle.holds(b"a<<S>b", b"<S>") and not fill_in_middle.holds(b"<S <S", b"<S>") and not fill_in_middle.holds(b"", b"<S>")


def test_bad_sentinels_and_templates():
    with pytest.raises(ValueError):
        chat_examples.Template("<s>", "<s>", "</s>")
    with pytest.raises(ValueError):
        chat_examples.Template("<s>", "[x]", "<<s>")


@pytest.mark.parametrize("sentinels", [("<P>", "<P>", "<M>"), ("<P>", "[S]", "<M>"), ("<P<", "<S>", "<M>")])
def test_bad_sentinels(odd, sentinels):
    with pytest.raises(ValueError):
        fill_in_middle.fill_in_middle(odd, sentinels=sentinels)


SAID = ["", None, "plain", "</s>[INST] ok [/INST]", r"<\s> and <\\/s> and [\INST]", "<s", "[[INST]]", "<</s>>", "back\\slash \\", "$1 \\$2", "line\nline", "é日本" * 4000]


def conversations(spark):
    rows = [(c, t, ("system", "user", "assistant", None, "to</s>ol")[(c + t) % 5 if c % 2 else 1 + t % 2], SAID[(c * 7 + t) % len(SAID)]) for c in range(20) for t in range(c % 6 + 1)]
    rows += [(100, 1, "assistant", "b"), (100, 1, "assistant", "a"), (100, 1, "assistant", "a"), (100, None, "user", "first"), (None, 0, "user", "nobody"), (None, 1, "assistant", "said")]
    rows += [(200, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for t in range(300)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("last", F.lit("x")).withColumn("t", F.lit(0)), rows


def test_chat_examples(spark, tmp_path):
    table, rows = conversations(spark)
    table.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.queries()["op12_chat_examples"](spark, str(tmp_path)).collect()}
    said = {-1: [(0, "user", SAID[3]), (1, "assistant", SAID[3])]}
    for c, t, role, text in rows:
        said.setdefault(c, []).append((t, role or "", text or ""))
    assert set(got) == set(said)
    for c, turns in said.items():
        turns = sorted(turns, key=lambda x: (x[0] is not None, *[x[0] or 0, x[1], x[2]]))
        loss = "".join(x[2] for x in turns if x[1] == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{role}\n{text}\n" for _, role, text in turns))), c
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss)), c


def test_each_reply_has_all_turns_before_it_as_context(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "r</s>"), (1, 3, "user", "q2"), (1, 4, "assistant", "r2"), (1, 5, "user", "bye"), (2, 0, "user", "alone")], "conv_id long, turn long, role string, text string")
    rows = sorted((r.conv_id, r.example, r.text, r.text[r.loss_start : r.loss_start + r.loss_chars], r.trained, r.last) for r in chat_examples.chat_examples(turns).collect())
    a = r"<s>system[INST]s</s><s>user[INST]q</s><s>assistant[INST]r<\/s></s>"
    b = a + "<s>user[INST]q2</s><s>assistant[INST]r2</s>"
    assert rows == [(1, 1, a, r"r<\/s>", True, False), (1, 2, b, "r2", True, False), (1, 3, b + "<s>user[INST]bye</s>", "", False, True), (2, 1, "<s>user[INST]alone</s>", "", False, True)]
    plan = chat_examples.chat_examples(turns)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def lyndon_by_comparing(t):
    ends, shared, n = [], [], len(t)
    for i in range(n):
        j = next((j for j in range(i + 1, n) if t[j:] < t[i:]), n)
        ends.append(j)
        shared.append(next((m for m in range(n - j) if t[i + m] != t[j + m]), n - j))
    return ends, shared


def runs_by_comparing(t, times, least):
    """Every stretch with a period, kept where no smaller one is a period of it."""
    n, out = len(t), []
    for q in range(1, n // times + 1):
        same = [t[i] == t[i + q] for i in range(n - q)] + [False]
        a = None
        for i, s in enumerate(same):
            if s and a is None:
                a = i
            elif not s and a is not None:
                length = i - a + q
                if length >= max(least, times * q) and not any(all(t[x] == t[x + d] for x in range(a, a + length - d)) for d in range(1, q)):
                    out.append((a, length, q))
                a = None
    return sorted(out, key=lambda x: (x[0], x[2]))


def some_words(rng):
    t, k = [], rng.choice([1, 2, 2, 3, 5])
    while len(t) < rng.randrange(1, 60):
        t += [rng.randrange(k) for _ in range(rng.randrange(1, 7))] * rng.randrange(1, 6)
        a = rng.randrange(len(t))
        t += t[a : a + rng.randrange(12)]
    return t


def test_lyndon_words_and_runs_of_small_sequences():
    rng = random.Random(7)
    for _ in range(3000):
        t = some_words(rng)
        ends, shared, _ = periodic_runs.lyndon_words(t)
        assert (ends, shared) == lyndon_by_comparing(t)
        for times, least in ((2, 2), (4, 6)):
            assert periodic_runs.runs_of(t, times, least) == runs_by_comparing(t, times, least)


def test_comparisons_are_linear():
    fibonacci, rulers = [[0], [0, 1]], [0]
    while len(fibonacci[-1]) < 5000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    while len(rulers) < 5000:
        rulers = [*rulers, max(rulers) + 1, *rulers]
    made = [[0] * 5000, fibonacci[-1], rulers, ([0] * 70 + [1]) * 70, sum(([0] * i + [1] for i in range(100)), []), [random.Random(1).randrange(2) for _ in range(5000)], list(range(700)) * 8]
    for t in made:
        for s in (t, [-x for x in t]):
            assert periodic_runs.lyndon_words(s)[2] <= 3 * len(s)


def brute(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    ranks = {w: i for i, w in enumerate(sorted(set(words)))}
    runs = runs_by_comparing([ranks[w] for w in words], 4, 6) if n < 3000 else None
    return words, runs


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_periodic_runs(spark, sf_dir, odd, tmp_path, which):
    folder = sf_dir
    if which == "odd":
        rng = random.Random(3)
        more = [(1000 + i, " ".join(f"w{x}" for x in some_words(rng))) for i in range(300)]
        docs = odd.select("doc_id", "text", "words", "runs").unionByName(spark.createDataFrame(more, "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("runs", F.lit(1)))
        folder = str(tmp_path)
        docs.write.parquet(f"{folder}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = queries.queries()["op13_periodic_runs"](spark, folder).collect()
    assert len(got) == len(texts)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    checked = found = 0
    for doc_id, text in texts:
        if doc_id is None:
            continue
        words, runs = brute(doc_id, text)
        if runs is None:
            continue
        r, checked, found = by_id[doc_id], checked + 1, found + len(runs)
        gone = {i for a, length, p in runs for i in range(a + p, a + length)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else None
        assert (r.n_runs, r.runs_sha256) == (len(runs), sha("".join(f"{a},{length},{p}\n" for a, length, p in runs))), doc_id
        assert r.collapsed_sha256 == sha(" ".join(w for i, w in enumerate(words) if i not in gone)), doc_id
        assert (r.start, r.length, r.period, r.exponent_milli) == ((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), doc_id
    assert checked > 150 and found > 10


@pytest.mark.parametrize("name,rows", [("op11_fill_in_middle", 0), ("op12_chat_examples", 1), ("op13_periodic_runs", 0)])
def test_empty_tables(spark, sf_dir, name, rows, tmp_path):
    for t in ("documents", "conversations"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.queries()[name](spark, str(tmp_path)).count() == rows
