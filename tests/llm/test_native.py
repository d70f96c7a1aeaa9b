"""Operators made of DataFrame functions alone: mixing, certified rules, digests, URL rules."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import CLASHING
from tidemark.llm import fingerprints, mixing, quality_rules, url_filter
from tidemark.llm.queries import RULES


def plan_text(df):
    return df._jdf.queryExecution().toString()


def test_mix_meets_targets(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r["source"]] += len(brute.words(r["text"]))
    want = brute.targets(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], abs_tol=1e-6)
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        assert math.floor(r["expected"] + 1e-9) <= r["copies"] <= math.ceil(r["expected"] - 1e-9) or r["size"] == 0
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    assert "Python" not in plan_text(mixing.mix(docs)) and "Arrow" not in plan_text(mixing.mix(docs))


def test_mixed_documents_keep_columns(docs, none):
    plan = Counter()
    for r in mixing.mix(docs).collect():
        plan[(r["doc_id"], r["source"], r["size"])] += r["copies"]
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], r["source"], len(brute.words(r["text"]))) for r in out.collect())
    assert got == Counter({k: v for k, v in plan.items() if v})
    assert mixing.mixed_documents(none).count() == 0 and mixing.mix(none).count() == 0


def test_long_texts_are_likelier(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a b c d").otherwise("a b c d " * 16).alias("text"), F.when(F.col("id") < 3000, "x").otherwise("y").alias("source"))
    got = mixing.mix(df).where("source = 'x'").groupBy("size").agg(F.avg("copies").alias("copies"), F.avg("expected").alias("expected")).orderBy("size").collect()
    assert got[1]["expected"] > 2 * got[0]["expected"]
    for r in got:
        assert abs(r["copies"] - r["expected"]) < 0.06


def test_fill_reshares_excess(spark):
    df = spark.createDataFrame([("a", 1.0, 100.0), ("b", 2.0, 3.0), ("c", 3.0, 3.0), ("d", 0.0, 9.0)], "source string, w double, cap double").withColumn("one", F.lit(1))
    out = {r["source"]: r["t"] for r in mixing.fill(df, F.lit(60.0), F.col("w"), F.col("cap"), ["one"], ["source"], "t").collect()}
    assert out == {"a": 54.0, "b": 3.0, "c": 3.0, "d": 0.0}


def test_base_counts(docs):
    for r, d in zip(quality_rules.base_counts(docs).collect(), docs.collect(), strict=True):
        t, w = d["text"] or "", brute.words(d["text"])
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), brute.dup_lines(t), brute.repeat_words(t))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want


@pytest.mark.parametrize(("k", "n", "p"), [(0, 10, 0.1), (3, 50, 0.02), (40, 1000, 0.05)])
def test_binomial_cdf(spark, k, n, p):
    want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert math.isclose(spark.range(1).select(quality_rules.binomial_cdf(F.lit(k), F.lit(n), p)).first()[0], want, rel_tol=1e-9)


def flat(df, **given):
    return df.select("*", *[given.get(m, F.lit(0.0)).alias(m) for m in quality_rules.CUTOFFS])


def test_levels_bound_false_rejections(spark):
    # Stratum a: clean rows with 0.018 symbols; b: half of the rows above every cutoff; c: too few rows.
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("stratum"), "id")
    rows = flat(rows, symbol_share=F.when(F.col("id") % 4 == 3, 0.9).otherwise(0.018))
    rows = rows.unionByName(flat(spark.range(20).select(F.lit("c").alias("stratum"), "id")))
    found = {(r["stratum"], r["pooled"]): r for r in quality_rules.certified_levels(rows).collect()}
    strictest = max(i for i, c in enumerate(quality_rules.CUTOFFS["symbol_share"]) if c >= 0.018)
    assert found[("a", False)]["level"] == strictest and found[("a", False)]["own"]
    assert found[("b", False)]["level"] is None and found[("b", False)]["own"] and not found[("c", False)]["own"]
    assert found[(None, True)]["n"] == 4020 and found[(None, True)]["level"] is None


def test_levels_are_those_of_a_plain_version(spark):
    import random

    r = random.Random(5)
    data = [(s, *[abs(r.gauss(0, 1)) ** 3 * c[-1] / 3 for c in quality_rules.CUTOFFS.values()]) for s, n in (("a", 700), ("b", 300), ("c", 90), (None, 400)) for _ in range(n)]
    df = spark.createDataFrame(data, "stratum string, " + ", ".join(f"{m} double" for m in quality_rules.CUTOFFS))
    for risk in (0.02, 0.05, 0.2):
        want, alpha = {}, 0.05 / 5
        for stratum, pooled in (("a", False), ("b", False), ("c", False), (None, False), (None, True)):
            rows = [x[1:] for x in data if pooled or x[0] == stratum]
            level, n = None, len(rows)
            for i in range(quality_rules.LEVELS):
                k = sum(any(v > c[i] for v, c in zip(x, quality_rules.CUTOFFS.values(), strict=True)) for x in rows)
                if sum(math.comb(n, j) * risk**j * (1 - risk) ** (n - j) for j in range(k + 1)) > alpha:
                    break
                level = i
            want[(stratum, pooled)] = (n, (1 - risk) ** n <= alpha, level)
        assert {(x["stratum"], x["pooled"]): (x["n"], x["own"], x["level"]) for x in quality_rules.certified_levels(df, risk).collect()} == want


def test_false_rejections_keep_the_risk():
    """In at most 5% of draws of a stratum of one language does the certified level reject over 2% of the clean rows to come."""
    import numpy as np

    r, n, risk, alpha = np.random.default_rng(4), 600, 0.02, 0.05 / 2
    true = np.linspace(0.002, 0.05, quality_rules.LEVELS)  # share of clean rows that each level rejects
    tail = np.cumsum([math.comb(n, j) * risk**j * (1 - risk) ** (n - j) for j in range(60)])
    over = 0
    for _ in range(2000):
        k = (r.random(n)[:, None] < true).sum(0)
        passed = (k < 60) & (tail[np.minimum(k, 59)] <= alpha)
        level = quality_rules.LEVELS if passed.all() else int(np.argmin(passed))
        over += level > 0 and true[level - 1] > risk
    assert over / 2000 <= 0.05


def test_measures_reject_rows(spark):
    """Of three languages one has enough clean rows for a level of its own; the others take that of all rows."""
    text = lambda i: " ".join(f"word{(i * 7 + j) % 97}x{i}" for j in range(20))
    rows = [(i, text(i), "en" if i < 600 else "fr" if i < 640 else None) for i in range(660)]
    rows += [(1000, text(1) + " ###" * 30, "en"), (1001, text(2) + " ###" * 30, "fr"), (1002, text(3) + " |||" * 30, None), (1003, text(4) + " $$$" * 30, "new"), (1004, text(5), "new"), (1005, "# " * 30, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.range(660).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(docs, labels).collect()}
    assert [got[i]["kept"] for i in range(1000, 1006)] == [False, False, False, False, True, False]
    assert all("symbol_share" in got[i]["rejected_by"] and not got[i]["base_failed"] for i in range(1000, 1004) if not got[i]["base_failed"])
    assert sum(not got[i]["kept"] for i in range(660)) <= 0.02 * 660


def test_rules(docs, none, labels):
    got = quality_rules.apply_rules(docs, labels)
    assert "Python" not in plan_text(got) and "Arrow" not in plan_text(got)
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.apply_rules(none, labels).count() == 0
    assert quality_rules.apply_rules(docs, labels.where("1 = 0")).where("not kept and not base_failed").count() == 0


def test_fingerprints(docs, none):
    import hashlib

    rows = docs.collect()
    ids = sorted({r["doc_id"] for r in rows if r["doc_id"] is not None}) + [None]
    by_id = defaultdict(list)
    for r in rows:
        by_id[r["doc_id"]].append(r["text"] or "")
    follow = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    longest = {i: max(len(t) // 4 for t in by_id[i]) for i in ids}
    got = fingerprints.fingerprint_edits(docs)
    assert "Python" not in plan_text(got) and "Arrow" not in plan_text(got)
    got = got.collect()
    assert len(got) == len(rows)
    want = Counter()
    for r in rows:
        t, i = r["text"] or "", r["doc_id"]
        start = min(x[: longest[i]] for x in by_id[follow[i]])
        k = len(t) // 4
        e = t[: len(t) - k] + start[:k]
        want[(i, len(t), hashlib.sha256(e.encode()).hexdigest(), float(brute.canonical(e) == brute.canonical(t)))] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"]) for r in got) == want
    prints = defaultdict(set)
    by_text = {(r["doc_id"], len(r["text"] or "")): brute.canonical(r["text"]) for r in rows}
    for r in got:
        prints[by_text[(r["doc_id"], r["n_chars"])]].add(r["fingerprint"])
    assert all(len(v) == 1 for v in prints.values()) and len({x for v in prints.values() for x in v}) == len(prints)
    near = {r["doc_id"]: r["near_next"] for r in got}
    assert near[30] == 1.0 and near[44] == 1.0 and near[0] == 0.0
    assert fingerprints.fingerprint_edits(none).count() == 0
    assert fingerprints.fingerprint_edits(docs.limit(1)).count() == 1


def judged(u):
    u = u or ""
    rest = u.split("://", 1)[1] if "://" in u else ""
    host, path, at = "", "", 0
    while at < len(rest) and rest[at] not in "/?#":
        at += 1
    host, rest = brute.lower(rest[:at]), rest[at:]
    at = 0
    while at < len(rest) and rest[at] not in "?#":
        at += 1
    path = rest[:at]
    best = max(((len(h + p), len(h), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


URLS = [
    "http://a.EXAMPLE.com/en/7x?q#f", "https://example.com/en/8", "ftp://x.net/de/", "http://www.example.net/de/81", "http://example.net/de", "https://b.org/es/a//b", "org/es/", "", None,
    "http://org/es/", "http://.org/es/1", "http://a..com/en/", "http://a.com", "http://a.com?x=/en/", "http://a.com#/en/", "http://u:p@q.com:80/en/1", "http://q.com.:80/en/1", "://com/en/", "http://xcom/en/1", "http://é.com/en/ß",
    "http://a.com/en/7://example.com/en/7", "http://a.com/en/\nx",
]


def test_urls(spark):
    rules = spark.createDataFrame([*RULES, RULES[0], (None, "/x", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([*enumerate(URLS), (0, URLS[0]), (0, URLS[0]), (None, URLS[1]), (None, URLS[1]), (3, None)], "page_id long, url string").withColumn("host", F.lit("x")).withColumn("_key", F.lit(1))
    want = Counter((r["page_id"], *judged(r["url"])) for r in pages.collect())
    assert Counter(tuple(r) for r in url_filter.judge_urls(pages, rules).collect()) == want
    assert url_filter.judge_urls(pages.where("1 = 0"), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(pages, rules.where("1 = 0")).collect()} == {"allow"}
    assert len(CLASHING) > 3


def test_very_long_hosts(spark):
    """A host brings as many expressions as the rules have numbers of labels, whatever its own."""
    import time

    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    urls = ["http://" + "a." * 100_000 + "com/en/x", "http://" + "." * 50_000 + "net/de/", "http://..com/en/", "http://com./en/", "http://.com/en/", "http://x.example.com/en/7", "http://" + "b" * 300_000 + "/de/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = Counter((i, *judged(u)) for i, u in enumerate(urls))
    url_filter.judge_urls(pages.limit(1), rules).collect()
    began = time.time()
    assert Counter(tuple(r) for r in url_filter.judge_urls(pages, rules).collect()) == want
    assert time.time() - began < 10
