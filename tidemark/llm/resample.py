"""Importance resampling towards a target text distribution, by hashed n-gram counts, in Spark SQL alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import let, stash

#: Characters that are no part of a word: ASCII without digits and small letters. All others are.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def feature_words(text: Column) -> Column:
    """The words of a text in order, A-Z lower-cased; null text: none."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, BETWEEN), lambda w: w != "")


def bucket_arrays(text: Column, max_n: int, buckets: int) -> Column:
    """struct(n_words, buckets): the bucket of every run of 1 to max_n consecutive words, repeats included."""

    def grams(words: Column, n: int) -> Column:
        if n == 1:
            return words
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    def of(words: Column) -> Column:
        hashed = [F.transform(grams(words, n), lambda g: (F.crc32(g.cast("binary")) % buckets).cast("int")) for n in range(1, max_n + 1)]
        return F.struct(F.size(words).cast("long").alias("n_words"), (F.concat(*hashed) if max_n > 1 else hashed[0]).alias("buckets"))

    return let(feature_words(text), of)


def bucket_counts(hashed: DataFrame, name: str) -> DataFrame:
    """How often each bucket occurs; one row per bucket that does, so at most as many as there are buckets."""
    return hashed.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def gain_table(docs: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain: floor(1000 ln) of the target's smoothed share of a bucket over the documents', for buckets that documents hold.

    docs and target are rows with an array `buckets`. The two tables of counts and the result have at most `buckets` rows.
    """
    s, t = stash(bucket_counts(docs, "s"), "resample-counts"), stash(bucket_counts(target, "t"), "resample-target-counts")
    total = lambda df, c: float(df.agg(F.coalesce(F.sum(c), F.lit(0))).first()[0])
    of_docs, of_target = total(s, "s") + buckets, total(t, "t") + buckets
    both = s.join(F.broadcast(t), "bucket", "left").select("bucket", F.col("s").cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t"))
    share = (F.col("t") + 1) * F.lit(of_docs) / ((F.col("s") + 1) * F.lit(of_target))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.ln(share)).alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from the id alone; null id: that of an id without digits."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """rows with their place, 1 and up, in the order given, without a task that sees them all.

    The rows are sorted across partitions and written with their place inside their partition; how many rows the partitions before
    have is then added. Of each partition one number is kept, so what is broadcast is as long as the sort has partitions.
    """
    placed = rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = stash(placed.select("*", F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_nth")).drop("_at"), "resample-order")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_nth") + 1).drop("_part", "_nth", "_before")


def resample(
    docs: DataFrame, target: DataFrame, max_n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024
) -> DataFrame:
    """One row per row of docs: doc_id, n_features, weight, score, rank (null: not drawn), all whole numbers.

    A document's features are its runs of 1 to max_n words, each in the bucket of its crc32. A bucket's gain compares the target's
    texts with all documents; weight is the mean gain, rounded down, 0 for documents without words. score adds Gumbel noise that
    depends on the id alone, so that the highest scores are a sample without replacement with odds exp(weight / 1000). Of the N
    documents with at least least_words words the floor(percent * N / 100) highest are drawn, ties to the smaller id.

    Texts are tokenised once and their buckets written. Exploded buckets are summed in the task that read them before anything is
    shuffled, so that neither a common word nor a long text is a hot key: what travels is one row per document, or one per bucket and
    task. The gain table is broadcast; it has `buckets` rows at most. Ranks come of a sort over all partitions.

    Null texts count as empty, a null id as one without digits, last among ties. Repeated rows stay apart and have ranks of their own.
    An empty docs gives no rows; with an empty target all buckets lose alike by their own counts. Other columns are left out.
    """
    hashed = docs.select("doc_id", bucket_arrays(F.col("text"), max_n, buckets).alias("_h"))
    hashed = stash(hashed.select("doc_id", "_h.n_words", "_h.buckets", F.monotonically_increasing_id().alias("_row")), "resample-buckets")
    gains = gain_table(hashed, target.select(bucket_arrays(F.col("text"), max_n, buckets).alias("_h")).select("_h.buckets"), buckets)

    each = hashed.select("_row", "doc_id", "n_words", F.explode_outer("buckets").alias("bucket")).join(F.broadcast(gains), "bucket", "left")
    summed = each.groupBy("_row", "doc_id", "n_words").agg(F.sum("gain").alias("_sum"), F.count("bucket").alias("n_features"))
    weight = F.when(F.col("n_features") > 0, F.expr("(_sum - pmod(_sum, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    scored = summed.select("_row", "doc_id", "n_words", "n_features", weight.alias("weight"))
    scored = stash(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "resample-scores")

    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    order = ranked(able, [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row")])
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).cast("long")
    keep = ["doc_id", "n_features", "weight", "score"]
    return order.select(*keep, rank.alias("rank")).unionByName(scored.where(F.col("n_words") < least_words).select(*keep, F.lit(None).cast("long").alias("rank")))
