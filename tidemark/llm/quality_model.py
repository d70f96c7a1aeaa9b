"""Document quality by Bradley-Terry pairwise ranking."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import BLANKS, crc_of_id, let, n_words, words

#: At most so many labelled rows of each label are fitted on: those of smallest id hash. The bound holds at every corpus size.
MOST_LABELLED = 4000
PAIRS_PER_ROW = 8
FEATURES = ("symbols", "shouting", "marks", "pipes", "digits", "stops", "length", "long_words", "variety", "same_lines", "size", "inner_capitals", "breaks", "stutter", "richness")


def features(text: Column) -> list[Column]:
    """Numbers that describe a whole text; all defined for null and empty ones. Only the text goes in."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(n_words(t), F.lit(1)).cast("double")
    chars = F.greatest(F.length(F.translate(t, BLANKS, "")), F.lit(1)).cast("double")
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("double")
    among = lambda letters: (F.length(t) - F.length(F.translate(t, letters, ""))).cast("double")
    distinct = F.size(F.array_distinct(F.transform(words(t), lambda w: F.xxhash64(w)))).cast("double")
    lines = let(F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(x)) > 0), lambda x: (F.size(x) - F.size(F.array_distinct(x))) / F.greatest(F.size(x), F.lit(1)))
    root = lambda c: F.sqrt(F.least(c, F.lit(1.0)))
    return [c.cast("double").alias(name) for name, c in zip(FEATURES, (
        root(among("#*$%&<>~^_=+@\\{}[]") / n / 3), root(count(r"\p{Lu}") / chars), root(among("!?") / n / 2), root(among("|") / n), root(count("[0-9]") / chars),
        root(among(".,") / n), F.log1p(chars / n), root(count(r"[^\x20\x09-\x0D]{14,}") / n), distinct / n * F.least(F.log1p(n) / 6, F.lit(1.0)), lines, F.log1p(n) / 8,
        root(count(r"\p{Ll}\p{Lu}") / n), root(among("\n") / n),
        root(count(r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+\1(?![^\x20\x09-\x0D])") / n), F.log1p(distinct) / F.log1p(n),
    ), strict=True)]


@dataclass(frozen=True)
class QualityModel:
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    cut: float
    steepness: float
    threshold: float

    def score(self, text: Column) -> Column:
        """0 to 1, increasing with the Bradley-Terry score; `threshold` at the quantile that was chosen as cut."""
        parts = [(f - F.lit(m)) * F.lit(w / s) for f, m, s, w in zip(features(text), self.mean, self.scale, self.weights, strict=True)]
        raw = parts[0]
        for p in parts[1:]:
            raw = raw + p
        z = F.lit(self.steepness) * (raw - F.lit(self.cut)) + F.lit(math.log(self.threshold / (1 - self.threshold)))
        return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0))))


def fit_pairs(x: np.ndarray, y: np.ndarray, seed: int = 7, ridge: float = 1e-2) -> np.ndarray:
    """Weights w that maximise the likelihood of preferences, P(a before b) = sigmoid(w (x_a - x_b)), by Newton steps."""
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return np.zeros(x.shape[1])
    a = np.concatenate([np.repeat(good, PAIRS_PER_ROW), rng.choice(good, len(bad) * PAIRS_PER_ROW)])
    b = np.concatenate([rng.choice(bad, len(good) * PAIRS_PER_ROW), np.repeat(bad, PAIRS_PER_ROW)])
    d, w = x[a] - x[b], np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))
        gradient = d.T @ (1 - p) / len(d) - ridge * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def best_quantile(raw: np.ndarray, y: np.ndarray) -> float:
    """The quantile of the scores at which rejecting what lies below gives the best balanced accuracy; clean rows weigh double."""
    order = np.argsort(raw, kind="stable")
    low = np.cumsum(y[order] == 0) / max(1, (y == 0).sum())
    lost = np.cumsum(y[order] == 1) / max(1, (y == 1).sum())
    gain = np.concatenate([[0.0], low - 2 * lost])
    gain[1:-1][raw[order][1:] == raw[order][:-1]] = -1  # no cut between equal scores
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(best[len(best) // 2]) / max(1, len(raw))


def fit(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, most: int = MOST_LABELLED) -> QualityModel:
    """Learns from labelled rows outside the held-out fold, at most `most` of each label, chosen by a hash of their id.

    Ids with contradictory or null labels are left out, repeated agreeing labels count once. If only one label (or none) is there, all
    scores are equal and above the threshold. The cut is a quantile of the fitted scores; between its neighbours it is put halfway.
    """
    asked = labels.where(crc_of_id(F.col("doc_id")) % folds != 0).groupBy("doc_id").agg(F.min("quality").alias("_low"), F.max("quality").alias("_high"))
    asked = asked.where("_low = _high").select("doc_id", F.col("_low").alias("_label"))
    order = F.xxhash64(F.lit(3).cast("long"), "doc_id")
    some = asked.where("_label = 1").orderBy(order, "doc_id").limit(most).unionByName(asked.where("_label = 0").orderBy(order, "doc_id").limit(most))
    # At most 2 * most ids: small enough to broadcast at any corpus size.
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    got = rows.groupBy("doc_id", "_label").agg(F.min("text").alias("text")).select("doc_id", "_label", *features(F.col("text"))).toPandas().sort_values("doc_id")
    x, y = got[list(FEATURES)].to_numpy(float), got["_label"].to_numpy(int)
    if len(set(y.tolist())) < 2:
        zero = (0.0,) * len(FEATURES)
        return QualityModel(zero, (1.0,) * len(FEATURES), zero, -1.0, 1.0, threshold)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = (x - mean) / scale
    w = fit_pairs(z, y)
    raw = z @ w
    k = round(best_quantile(raw, y) * len(raw))
    ordered = np.sort(raw)
    cut = (ordered[max(0, k - 1)] + ordered[min(k, len(raw) - 1)]) / 2
    return QualityModel(tuple(mean.tolist()), tuple(scale.tolist()), tuple(w.tolist()), float(cut), 1.0, threshold)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, null and empty texts too.

    labels, lang, source and doc_id are no inputs of a score; labels of the held-out fold (crc32 of the id mod 5 = 0) are never read. A
    null id is not held out. Extra columns are left out.
    """
    model = fit(docs, labels, threshold)
    out = docs.select("doc_id", F.coalesce(crc_of_id(F.col("doc_id")) % 5 == 0, F.lit(False)).alias("held_out"), model.score(F.col("text")).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))
