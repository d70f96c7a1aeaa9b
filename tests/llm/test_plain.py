"""Plain versions of the rows that Pareto sampling draws, and of the features and scores of quality ranking."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import mixing, quality_model
from tidemark.llm.shared import uniform

BLANK = r"\x20\x09-\x0D"


@pytest.mark.parametrize("how", [{}, {"weights": (5.0, 1.0), "share": 0.4, "seed": 3}, {"long_text_power": 1.0, "most": 2.0}])
def test_pareto_draws_equal_plain_version(docs, how):
    """The same random numbers, ranked and filled source by source without slices."""
    mark = F.xxhash64("doc_id", "source", "text")
    numbers = {r["m"]: r["u"] for r in docs.select(mark.alias("m"), uniform(how.get("seed", 17), mark).alias("u")).collect()}
    got = mixing.mix(docs, **how).collect()
    by_source = defaultdict(list)
    for r in got:
        by_source[r["source"]].append(r)
    for rows in by_source.values():
        whole = {id(r): math.floor(r["expected"] + mixing.SMALL) for r in rows}
        rest = max(0.0, rows[0]["target"] - sum(whole[id(r)] * r["size"] for r in rows))
        ranked = []
        for r in rows:
            p, u = max(0.0, r["expected"] - whole[id(r)]), numbers[r["_mark"]]
            if p > mixing.SMALL:
                ranked.append((u * (1 - p) / (u * (1 - p) + (1 - u) * p), r["_mark"], r["size"]))
        want, before = Counter(), 0
        for rank in sorted(ranked):
            want[rank[1]] += before + rank[2] / 2 <= rest
            before += rank[2]
        drawn = Counter()
        for r in rows:
            drawn[r["_mark"]] += r["copies"] - whole[id(r)]
        assert +drawn == +want


def plain_features(text):
    t = text or ""
    words = brute.words(t)
    n, chars = max(len(words), 1), max(sum(c not in " \t\n\x0b\x0c\r" for c in t), 1)
    among = lambda letters: sum(c in letters for c in t)
    count = lambda pattern: len(list(regex.finditer(pattern, t)))
    root = lambda x: math.sqrt(min(x, 1.0))
    lines = [x for x in t.split("\n") if x.strip(" ")]
    distinct = len(set(words))
    return [
        root(among("#*$%&<>~^_=+@\\{}[]") / n / 3), root(count(r"\p{Lu}") / chars), root(among("!?") / n / 2), root(among("|") / n), root(count("[0-9]") / chars), root(among(".,") / n), math.log1p(chars / n),
        root(sum(len(w) >= 14 for w in words) / n), distinct / n * min(math.log1p(n) / 6, 1.0), (len(lines) - len(set(lines))) / max(len(lines), 1), math.log1p(n) / 8, root(count(r"\p{Ll}\p{Lu}") / n), root(among("\n") / n),
        root(count(rf"(?<![^{BLANK}])([^{BLANK}]+)[{BLANK}]+\1(?![^{BLANK}])") / n), math.log1p(distinct) / math.log1p(n),
    ]


ODD = ["a a a a", "same same. Same", "x  x\ty y\ny", "WORD wORd aB cD " * 3, "1,2.3!?|#$", "\n\n a\n a\n\n", "ﬀ ß É é̂ 漢字 漢字", "word" * 4000 + " z z", "very-long-word-of-many-letters " * 4, None, "", "   "]


def test_features_and_scores_equal_plain_version(spark, small, docs, labels):
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    sets = [(docs.select("doc_id", "text").unionByName(odd), docs, labels), (spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"), None, spark.read.parquet(f"{small}/labels.parquet"))]
    for rows, taught, marks in sets:
        model = quality_model.fit(taught if taught is not None else rows, marks)
        got = rows.select("text", F.array(*quality_model.features(F.col("text"))).alias("f"), model.score(F.col("text")).alias("s")).collect()
        for r in got:
            want = plain_features(r["text"])
            assert np.allclose(r["f"], want, atol=1e-9), r["text"]
            raw = sum((f - m) / s * w for f, m, s, w in zip(want, model.mean, model.scale, model.weights, strict=True))
            z = model.steepness * (raw - model.cut) + math.log(model.threshold / (1 - model.threshold))
            assert abs(r["s"] - 1 / (1 + math.exp(-max(-40, min(40, z))))) < 1e-9


def test_fit_is_the_best_for_its_pairs():
    """No small step from the fitted weights raises the penalised likelihood."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 3))
    y = (x @ np.array([1.0, -2.0, 0.0]) + rng.normal(size=120) > 0).astype(int)
    w = quality_model.fit_pairs(x, y, seed=7)
    again = np.random.default_rng(7)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    k = quality_model.PAIRS_PER_ROW
    a = np.concatenate([np.repeat(good, k), again.choice(good, len(bad) * k)])
    b = np.concatenate([again.choice(bad, len(good) * k), np.repeat(bad, k)])
    gain = lambda v: -np.log1p(np.exp(-(x[a] - x[b]) @ v)).mean() - 0.005 * v @ v
    assert all(gain(w) >= gain(w + step) for step in rng.normal(size=(200, 3)) * 0.01) and w[0] > 0 > w[1]
