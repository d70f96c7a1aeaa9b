"""Fill-in-middle, importance resampling and chat formatting against plain versions."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import CLASHING
from tidemark.llm import chat, fim, resample

NASTY = ["<P>", "a<S>b\n", "\n", "\n\n\n", "x\r\ny", "é\n\x00ß\nlast", "<\nP>\n<", "'\";--\n$$", "\\\n\\n", "one line", "ends\n", "<M", "M>\n" * 5]


@pytest.fixture(scope="module")
def texts(spark, docs):
    """The edge cases of all corpus tests, and texts that hold marks, blanks and quotes."""
    made = spark.createDataFrame([(1000 + i, t, "en", "s0") for i, t in enumerate(NASTY)], "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return docs.unionByName(made.select("*", *[F.lit("clash").alias(c) for c in CLASHING]))


def plain_fim(doc_id, text, marks=("<P>", "<S>", "<M>"), salt="7", rate=100, spm=50):
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    h = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not t or any(m in t for m in marks) or h3 % 100 >= rate:
        return doc_id, len(units), "plain", None, None, t
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return doc_id, len(units), "spm", len(p), len(m), marks[1] + s + marks[0] + p + marks[2] + m
    return doc_id, len(units), "psm", len(p), len(m), marks[0] + p + marks[1] + s + marks[2] + m


@pytest.mark.parametrize("how", [{}, {"rate": 40, "spm": 10, "salt": "x'y"}, {"marks": ("|a", "|b", "|c")}])
def test_fim_equals_plain_version(texts, how):
    want = Counter(plain_fim(r["doc_id"], r["text"], **how) for r in texts.collect())
    got = fim.fill_in_middle(texts, **how)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"] and got.schema["doc_id"].dataType.simpleString() == "bigint"
    assert Counter(tuple(r) for r in got.collect()) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_fim_gives_every_text_back(texts, none):
    out = fim.fill_in_middle(texts)
    again = out.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("text"))
    assert Counter(map(tuple, again.collect())) == Counter((r["doc_id"], r["text"] or "") for r in texts.collect())
    assert fim.fill_in_middle(none).count() == 0


def test_fim_ids_and_columns_of_any_name(spark):
    df = spark.createDataFrame([("k", "a\nb\n", 1)], "output string, id string, form int").toDF("output", "id", "form")
    got = fim.fill_in_middle(df, id_col="output", text_col="id")
    assert got.count() == 1 and got.columns[1:5] == ["n", "form", "prefix_chars", "middle_chars"]


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("P", "<S>", "<M>"), ("<<", "<S>", "<M>"), ("<P", "<P>", "<M>"), ("", "", "<M>")])
def test_fim_refuses_marks_that_cannot_be_read_back(docs, marks):
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs, marks=marks)


def test_batches_are_cut_by_bytes():
    batch = pa.record_batch({"id": ["1", "2", "3", "4", "5"], "text": ["aa", "", "éé", "x" * 50, "y"]})
    parts = list(fim.parts_of(batch, 6))
    assert [p.column(0).to_pylist() for p in parts] == [["1", "2", "3"], ["4"], ["5"]]
    assert list(fim.parts_of(batch.slice(0, 0), 6)) == [] and sum(p.num_rows for p in fim.parts_of(batch.slice(2), 6)) == 3


def test_fim_shuffles_nothing(docs):
    plan = fim.fill_in_middle(docs)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan


def feature_words(t):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_resample(rows, target, max_n=1, buckets=10000, percent=10, least=20, seed=2024):
    def hashed(t):
        w = feature_words(t)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for r in rows:
        s.update(hashed(r[1]))
    for x in target:
        t.update(hashed(x))
    of_docs, of_target = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * of_docs / ((s[b] + 1) * of_target))) for b in s}
    out = []
    for doc_id, text in rows:
        h = hashed(text)
        weight = sum(gain[b] for b in h) // len(h) if h else 0
        u = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(h), weight, weight + math.floor(-1000 * math.log(-math.log((u + 0.5) / 4294967296))), None, len(feature_words(text))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize("how", [{}, {"max_n": 3, "buckets": 97, "percent": 60, "least_words": 3, "seed": 5}, {"percent": 100, "least_words": 0}])
def test_resample_equals_plain_version(spark, texts, how):
    target = spark.createDataFrame([("tare miso",), (None,), ("Lu\x00EN-da 7É",), ("",)], "text string").withColumn("doc_id", F.lit("clash"))
    plain_how = {{"least_words": "least"}.get(k, k): v for k, v in how.items()}
    want = plain_resample([(r["doc_id"], r["text"]) for r in texts.collect()], [r["text"] for r in target.collect()], **plain_how)
    got = resample.resample(texts, target, **how)
    assert dict(got.dtypes) == dict.fromkeys(["doc_id", "n_features", "weight", "score", "rank"], "bigint")
    have = Counter(tuple(r) for r in got.collect())
    # Rows alike in id and score, here copies of a row or rows without id, share their ranks among them.
    drop = lambda c: Counter({k: v for k, v in ((k, sum(n for x, n in c.items() if x[:4] == k)) for k in {x[:4] for x in c})})
    ranks = lambda c: sorted(x[4] for x in c.elements() if x[4] is not None)
    assert drop(have) == drop(want) and ranks(have) == ranks(want) == list(range(1, len(ranks(want)) + 1))
    once = {k for k, n in Counter(x[:1] + (x[3],) for x in have.elements()).items() if n == 1}
    assert {x for x in have if (x[0], x[3]) in once} == {x for x in want if (x[0], x[3]) in once}


def test_resample_without_rows_or_target(spark, docs, none):
    assert resample.resample(none, docs).count() == 0
    blank = resample.resample(docs, none).collect()
    assert len(blank) == docs.count() and all(r["weight"] <= 0 or r["n_features"] for r in blank)


def test_resample_draws_what_looks_like_the_target(spark):
    r = random.Random(3)
    side = {0: "ba be bi bo bu".split(), 1: "ka ke ki ko ku".split()}
    df = spark.createDataFrame([(i, " ".join(r.choice(side[i % 2]) for _ in range(40))) for i in range(2000)], "doc_id long, text string")
    target = spark.createDataFrame([(" ".join(r.choice(side[1]) for _ in range(3000)),)], "text string")
    drawn = resample.resample(df, target, percent=10).where("rank is not null").collect()
    assert len(drawn) == 200 and sum(x["doc_id"] % 2 for x in drawn) > 120
    assert sorted(x["rank"] for x in drawn) == list(range(1, 201)) and [x["score"] for x in sorted(drawn, key=lambda x: x["rank"])] == sorted((x["score"] for x in drawn), reverse=True)


def test_resample_stays_in_spark_sql(docs):
    plan = resample.resample(docs, docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


CONTROL = ["</turn>", "<turn:user>", "<next>", "\\", "\\b", "\\l", "\\\\l/turn>", "<", "<turn", "\n", "", "é\x00ß", ">", "\\g", "<tur\\n:", "</turn>\n<turn:assistant>x</turn>\n", "<<next>>", "\\l\\b\\"]


@pytest.fixture(scope="module")
def turns(spark):
    r = random.Random(9)
    rows = []
    for conv in range(40):
        for turn in range(r.randint(1, 9)):
            rows.append((conv, turn, r.choice(["user", "assistant", "assistant", "system"]), "".join(r.choice(CONTROL) for _ in range(r.randint(0, 4)))))
    rows += [(50, 0, a, b) for a, b in itertools.product(["a>b", "\\g", "assistant", ""], CONTROL)]
    rows += [(60, 0, "user", None), (60, 1, None, "no role"), (60, None, "assistant", "late"), (60, 2, "assistant", "a"), (60, 2, "assistant", "a"), (None, 0, "assistant", "no id"), (None, 1, "user", "x")]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.select("*", *[F.lit("clash").alias(c) for c in ("blocks", "formatted", "loss", "_turns", "late", "_pieces")])


def by_conversation(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["turn"] is None, r["turn"] or 0, r["role"] or "", r["text"] or "")):
        out.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    return out


def plain_format(turns):
    escape = lambda t: t.replace("\\", "\\b").replace("<turn:", "\\lturn:").replace("</turn>", "\\l/turn>").replace("<next>", "\\lnext>")
    blocks = [(role, [escape(t) for _, t in same]) for role, same in itertools.groupby(turns, key=lambda t: t[0])]
    return "".join(f"<turn:{escape(role).replace('>', chr(92) + 'g')}>" + "<next>".join(texts) + "</turn>\n" for role, texts in blocks)


def test_chat_equals_plain_version_and_reads_back(turns):
    want = by_conversation(turns)
    out = chat.format_conversations(turns)
    assert out.columns == ["conv_id", "blocks", "formatted", "loss"]
    got = out.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("learnt")).collect()
    assert {r["conv_id"] for r in got} == set(want) and len(got) == len(want)
    for r in got:
        t = want[r["conv_id"]]
        assert r["formatted"] == plain_format(t)
        assert [tuple(x) for x in r["turns"]] == t
        assert [(b["role"], list(b["texts"])) for b in r["blocks"]] == [(k, [x for _, x in g]) for k, g in itertools.groupby(t, key=lambda x: x[0])]
        said = [x for role, x in t if role == "assistant"]
        assert r["learnt"] == "".join(said) and len(r["loss"]) == len(said)
        raw = r["formatted"].encode()
        for span, text in zip(r["loss"], said, strict=True):
            part = raw[span["start"] : span["start"] + span["length"]].decode()
            assert part.replace("\\l", "<").replace("\\b", "\\") == text


def test_chat_learns_the_roles_named(turns):
    out = chat.format_conversations(turns, learnt=("user", "system"))
    got = out.select("conv_id", chat.loss_text(F.col("formatted"), F.col("loss"))).collect()
    want = by_conversation(turns)
    assert {r[0]: r[1] for r in got} == {k: "".join(x for role, x in v if role in ("user", "system")) for k, v in want.items()}


def test_chat_without_rows(turns):
    assert chat.format_conversations(turns.where("1 = 0")).count() == 0
    assert "Python" not in chat.format_conversations(turns)._jdf.queryExecution().toString()


def test_very_long_conversation(spark):
    """Time follows the length: no array is appended to turn by turn over a whole conversation."""
    n = 20_000
    df = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text <next> "), F.col("id").cast("string")).alias("text"))
    began = time.time()
    r = chat.format_conversations(df).select(F.size(chat.read_turns(F.col("formatted"))), F.length(chat.loss_text(F.col("formatted"), F.col("loss")))).first()
    assert tuple(r) == (n, sum(len(f"text <next> {i}") for i in range(n) if i % 3)) and time.time() - began < 60


def test_running_sums(spark):
    df = spark.createDataFrame([(0, []), (1, [5]), (2, [1, 2, 3]), (3, list(range(1000)))], "k int, v array<long>")
    got = {r[0]: r[1] for r in df.select("k", chat.running_sums(F.col("v"))).collect()}
    assert got == {0: [], 1: [5], 2: [1, 3, 6], 3: list(itertools.accumulate(range(1000)))}
