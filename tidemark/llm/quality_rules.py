"""Rule filters whose cutoffs are certified on labelled holdouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import BLANKS, let, n_words, stash, words

#: Strictness levels, from the laxest to the strictest. One level sets the cutoffs of all measures: rejected is what lies above any.
LEVELS = 24
#: The laxest and the strictest cutoff of each measure; those between are spaced by equal ratios. They are fixed beforehand, so every
#: labelled row is a holdout.
RANGE: dict[str, tuple[float, float]] = {
    "symbol_share": (0.4, 0.004), "shout_share": (0.5, 0.05), "mark_share": (0.4, 0.02), "dup_line_share": (0.5, 0.02), "repeat_share": (0.2, 0.1), "word_length": (15.0, 7.0),
}
CUTOFFS: dict[str, list[float]] = {m: [lax * (strict / lax) ** (i / (LEVELS - 1)) for i in range(LEVELS)] for m, (lax, strict) in RANGE.items()}
#: Strata up to this number are joined by broadcast.
BROADCAST_STRATA = 100_000


def repeated_window_words(text: Column, size: int = 5) -> Column:
    """Number of words inside windows of so many words that occur at least twice in the text (the first one counts too)."""

    def hashes(w: Column) -> Column:
        n = F.size(w)
        at = F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))

    def covered(h: Column) -> Column:
        # Equal hashes are neighbours once sorted; the repeated positions, in order, then cover at most `size` words each.
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(pairs, lambda p: F.filter(p, lambda x, k: (F.get(p, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(p, k + 1)["h"].eqNullSafe(x["h"]))))
        at = F.array_sort(F.transform(twice, lambda x: x["i"]))
        return let(at, lambda a: F.aggregate(a, F.struct(F.lit(-size).alias("last"), F.lit(0).alias("n")), lambda s, x: F.struct(x.alias("last"), (s["n"] + F.least(F.lit(size), x - s["last"])).alias("n")), lambda s: s["n"]))

    return let(let(words(text), hashes), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))).cast("long")


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, _mark and counts of whole texts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, upper, marks."""
    t = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    return docs.select(
        "doc_id", F.col("lang").alias("stratum"), n_words(t).alias("n_words"), F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_window_words(t).alias("n_repeat_words"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("upper"), (F.length(t) - F.length(F.translate(t, "!?", ""))).cast("long").alias("marks"),
    )


def measures(counts: DataFrame) -> DataFrame:
    chars, n = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    return counts.withColumns({
        "symbol_share": F.col("n_symbols") / chars, "shout_share": F.col("upper") / chars, "mark_share": F.col("marks") / chars,
        "dup_line_share": F.col("n_dup_lines") / n, "repeat_share": F.col("n_repeat_words") / n, "word_length": F.col("word_chars") / n,
    })


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), each term from the one before, in logarithms."""
    import math

    odds, start = math.log(p / (1 - p)), n * F.lit(math.log1p(-p))
    step = lambda s, i: let(s["t"] + F.log((n - i + 1) / i) + F.lit(odds), lambda t: F.struct(t.alias("t"), (s["sum"] + F.exp(t)).alias("sum")))
    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, F.struct(start.alias("t"), F.exp(start).alias("sum")), step, lambda s: s["sum"])


def rejected_at(level: int) -> Column:
    """Whether a row's measures lie above any cutoff of the level. Levels are nested: what one rejects, all stricter ones reject."""
    above = [F.col(m) > F.lit(cuts[level]) for m, cuts in CUTOFFS.items()]
    out = above[0]
    for c in above[1:]:
        out = out | c
    return out


def certified_levels(labelled: DataFrame, risk: float = 0.02, confidence: float = 0.95) -> DataFrame:
    """stratum, pooled, n, own, level: the strictest level at which each stratum's false rejections are certified (null: none).

    labelled has stratum and the measures of clean rows (label 1). A level passes if the exact binomial (Clopper-Pearson) upper bound of
    the share of clean rows that it rejects stays below the risk: P(X <= k | n, risk) <= alpha. Levels are tested in a fixed sequence from
    the laxest on, and the first that fails ends it, so that alpha needn't be divided among levels; it is divided by Bonferroni among the
    strata and one pool of all rows (pooled = true): alpha = (1 - confidence) / (strata + 1). Together, all certified levels keep
    the risk with the given confidence. own tells strata with enough clean rows to certify anything, (1 - risk) ** n <= alpha; the others
    have no level of their own. For them only the pool's level is certified, that is the false rejections over all strata together.
    """
    counted = labelled.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(rejected_at(i)).alias(f"k{i}") for i in range(LEVELS)])
    counted = stash(counted, "rule-counts-by-stratum")
    pool = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[F.coalesce(F.sum(f"k{i}"), F.lit(0)).alias(f"k{i}") for i in range(LEVELS)], F.count(F.lit(1)).alias("_strata"))
    # One row per stratum and one for the pool, that is as many as there are languages.
    alpha = F.lit(1 - confidence) / (F.max("_strata").over(Window.partitionBy(F.lit(0))) + 1)
    rows = counted.withColumn("pooled", F.lit(False)).unionByName(pool.withColumn("pooled", F.lit(True)), allowMissingColumns=True).withColumn("_alpha", alpha)
    rows = rows.withColumn("own", F.pow(F.lit(1 - risk), F.col("n")) <= F.col("_alpha"))

    def passes(k: Column) -> Column:
        # k above n * risk never passes, so the sum of terms stays short.
        return F.when(F.col("own") & (k <= F.col("n") * F.lit(risk)), binomial_cdf(k, F.col("n"), risk) <= F.col("_alpha")).otherwise(F.lit(False))

    failed = F.filter(F.transform(F.array(*[F.col(f"k{i}") for i in range(LEVELS)]), lambda k, i: F.when(passes(k), F.lit(None)).otherwise(i)), lambda i: i.isNotNull())
    rows = rows.withColumn("level", F.coalesce(F.get(failed, F.lit(0)), F.lit(LEVELS)) - 1)
    return rows.select("stratum", "pooled", "n", "own", F.when(F.col("level") >= 0, F.col("level")).cast("int").alias("level"))


def apply_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.02, confidence: float = 0.95) -> DataFrame:
    """doc_id, base counts, base_failed, kept, rejected_by for every row of docs.

    base_failed: fewer than 10 words, or over 20% of the words in repeated 5-word windows. Other rows are kept unless a measure lies
    above its cutoff at the level certified for their language, or, where a language has too few clean rows to certify anything, at the
    level certified for all languages together. Clean rows for certification are those with label quality = 1 that don't fail the
    base rules. Null texts have no words. A null language is a stratum of its own. Documents without a label only get the verdict;
    repeated labels of an id count once if they agree, and not at all if they differ. Without labels nothing is certified and only the
    base rules reject. Extra columns are left out.
    """
    counts = stash(base_counts(docs.select("doc_id", "text", "lang")), "rule-counts")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    counts = measures(counts).withColumn("base_failed", failed)
    clean = labels.groupBy("doc_id").agg(F.min("quality").alias("_low"), F.max("quality").alias("_high")).where("_low = 1 and _high = 1").select("doc_id")
    holdout = counts.where(~F.col("base_failed")).join(clean, "doc_id", "left_semi")
    found = stash(certified_levels(holdout, risk, confidence), "rule-levels")
    own = found.where("own and not pooled").select(F.col("stratum").alias("_s"), F.col("level").alias("_level"), F.lit(True).alias("_own"))
    if own.count() <= BROADCAST_STRATA:
        own = F.broadcast(own)
    pool = found.where("pooled").first()["level"]
    judged = counts.join(own, F.col("stratum").eqNullSafe(F.col("_s")), "left")
    judged = judged.withColumn("_at", F.when(F.col("_own"), F.col("_level")).otherwise(F.lit(pool).cast("int")))
    # Without a level the place is null, and so is the cutoff: nothing lies above it.
    by = [F.when(F.col(m) > F.get(F.array(*[F.lit(c) for c in cuts]), F.col("_at")), F.lit(m)) for m, cuts in CUTOFFS.items()]
    judged = judged.withColumn("rejected_by", F.when(F.col("base_failed"), F.array(F.lit("base"))).otherwise(F.filter(F.array(*by), lambda x: x.isNotNull())))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (F.size("rejected_by") == 0).alias("kept"),
        F.array_join("rejected_by", ",").alias("rejected_by"),
    )
