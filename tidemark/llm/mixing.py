"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import n_words, small, stash, uniform

#: The order statistic is found in this many equal slices of (0, 1); only one slice a source is then ranked row by row.
SLICES = 1 << 16
#: So many slices make one coarse slice.
FINE = 1 << 8
#: Preferences are rounded to quarter powers of two, so that a source has few strata, however many documents.
LEVELS_PER_OCTAVE = 4
SMALL = 1e-9


def fill(df: DataFrame, budget: Column, weight: Column, cap: Column, by: list[str], order: list[str], name: str) -> DataFrame:
    """Shares budget among the rows of each group in proportion to weight, none above cap, the excess reshared until it fits.

    Rows are ordered by the level at which they reach their cap; then prefix sums say which rows stay capped. One row per source or
    stratum goes in, so the windows are small. Rows of weight 0 get 0.
    """
    first = df.select("*", weight.cast("double").alias("_w"), cap.cast("double").alias("_cap"), budget.cast("double").alias("_budget"))
    first = first.withColumn("_level", F.when(F.col("_w") > 0, F.col("_cap") / F.col("_w")).otherwise(F.lit(0.0)))
    w = Window.partitionBy(*by).orderBy("_level", *order)
    before, all_rows = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = first.select(
        "*", F.coalesce(F.sum(F.when(F.col("_w") > 0, F.col("_cap"))).over(before), F.lit(0.0)).alias("_capped"),
        (F.sum("_w").over(all_rows) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))).alias("_left"),
    )
    # The common level if exactly the rows before this one are capped. The first row that it doesn't fill sets the level for all; the
    # trials of later rows are no higher.
    trial = F.when(F.col("_left") > SMALL, F.greatest((F.col("_budget") - F.col("_capped")) / F.col("_left"), F.lit(0.0)))
    summed = summed.withColumn("_trial", trial)
    reached = F.max(F.when((F.col("_w") > 0) & (F.col("_trial") <= F.col("_level")), F.col("_trial"))).over(all_rows)
    share = F.when(F.col("_w") <= 0, 0.0).otherwise(F.least(F.col("_cap"), F.col("_w") * F.coalesce(reached, F.lit(float("inf")))))
    return summed.withColumn(name, share).drop("_w", "_cap", "_budget", "_level", "_capped", "_left", "_trial")


def cycle_weights(sources: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """Gives the sources, by code point and null last, the weights in turn. One row per source."""
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn + 1))


def _last_started(slices: DataFrame, by: str) -> DataFrame:
    """Of each source's slices (columns _n, _rest and _offset) the last before which fewer than _rest words stand, and their number."""
    upto = F.col("_offset") + F.sum("_n").over(Window.partitionBy("source").orderBy(by))
    started = slices.withColumn("_before", upto - F.col("_n")).where(F.col("_before") < F.col("_rest"))
    return started.groupBy("source").agg(F.max_by(F.struct(by, "_before"), by).alias("_x")).select("source", f"_x.{by}", "_x._before")


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0, most: float = 3.0, long_text_power: float = 0.5, seed: int = 17
) -> DataFrame:
    """How often each document enters the mix: doc_id, source, size, source_size, target, expected, copies, taken, _row.

    A source's target is its part by weight of share times all words, at most `most` times its own words (the excess is reshared by
    weight). Inside a source the expected copies of a document are proportional to size ** long_text_power, at most `most`, so that the
    expected words meet the target. The whole part of the expected copies is certain. For the fraction p that remains, documents are
    ranked by odds(u) / odds(p) with u drawn from the row alone, and the lowest are taken until the source's remaining words are
    filled: a fixed-size Pareto sample with unequal probabilities, its size counted in words. The last document enters only if that
    brings the total nearer to the target, so a source misses by at most half a document.

    The rank is not made by sorting a source: ranks are counted in SLICES slices of (0, 1), and only the slice in which the total is
    reached is sorted. Null texts have size 0 and are never taken; null sources are one source, last by order. Repeated rows stay apart
    and share a rank, so that reruns give the same rows. Empty input gives an empty result. Extra columns are left out.
    """
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("doc_id", "source", "text").alias("_mark"))
    octave = F.round(F.log2(F.greatest(F.col("size"), F.lit(1)).cast("double")) * LEVELS_PER_OCTAVE)
    sized = stash(sized.withColumn("_stratum", F.when(F.col("size") > 0, octave.cast("int")).otherwise(-1)), "mix-sizes")

    strata = sized.groupBy("source", "_stratum").agg(F.sum("size").alias("_words"))
    sources = cycle_weights(strata.groupBy("source").agg(F.sum("_words").alias("source_size")), weights)
    sources = sources.withColumn("_all", F.sum("source_size").over(Window.partitionBy(F.lit(0))) * F.lit(share)).withColumn("_one", F.lit(0))
    sources = fill(sources, F.col("_all"), F.when(F.col("source_size") > 0, F.col("weight")).otherwise(0), F.col("source_size") * F.lit(most), ["_one"], ["source"], "target")
    strata = strata.join(sources.select(F.col("source").alias("_s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    liking = F.when(F.col("_words") > 0, F.col("_words") * F.pow(F.lit(2.0), F.col("_stratum") * F.lit(long_text_power / LEVELS_PER_OCTAVE))).otherwise(0)
    strata = fill(strata, F.col("target"), liking, F.col("_words") * F.lit(most), ["source"], ["_stratum"], "_share")
    expected = F.when(F.col("_words") > 0, F.col("_share") / F.col("_words")).otherwise(F.lit(0.0))
    strata = strata.withColumn("expected", F.least(expected, F.lit(float(most))))
    strata = strata.withColumn("_whole", F.floor(F.col("expected") + SMALL))
    strata = strata.withColumn("_p", F.greatest(F.col("expected") - F.col("_whole"), F.lit(0.0)))
    certain = F.sum(F.col("_whole") * F.col("_words")).over(Window.partitionBy("source"))
    strata = stash(strata.withColumn("_rest", F.greatest(F.col("target") - certain, F.lit(0.0))), "mix-strata")

    # Strata and sources are few in practice: once counted they are broadcast, so that no row is dealt by its source.
    slim = strata.select(F.col("source").alias("_s"), F.col("_stratum").alias("_t"), "source_size", "target", "expected", "_whole", "_p", "_rest")
    rows = sized.join(small(slim), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_stratum") == F.col("_t"))).drop("_s", "_t")
    u = uniform(seed, F.col("_mark"))
    # q / (1 + q) of the Pareto ranking variable q = odds(u) / odds(p): the same order, within (0, 1).
    rank = F.when(F.col("_p") > SMALL, u * (1 - F.col("_p")) / (u * (1 - F.col("_p")) + (1 - u) * F.col("_p")))
    rows = rows.withColumn("_rank", rank).withColumn("_slice", F.floor(F.col("_rank") * SLICES).cast("int"))

    # The slice that fills a source is sought in two steps, so that no window is over more than 256 rows a source.
    slices = stash(rows.where("_slice is not null").groupBy("source", "_slice", "_rest").agg(F.sum("size").alias("_n")), "mix-slices")
    coarse = slices.groupBy("source", "_rest", F.floor(F.col("_slice") / FINE).alias("_part")).agg(F.sum("_n").alias("_n"))
    part = _last_started(coarse.withColumn("_offset", F.lit(0).cast("long")), "_part").select(F.col("source").alias("_s"), F.col("_part"), F.col("_before").alias("_offset"))
    fine = slices.withColumn("_p", F.floor(F.col("_slice") / FINE)).join(part, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_p") == F.col("_part"))).drop("_s", "_p", "_part")
    last = stash(_last_started(fine, "_slice").select(F.col("source").alias("_s"), F.col("_slice").alias("_last"), "_before"), "mix-last-slices")
    rows = rows.join(small(last), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")

    whole_slice = F.coalesce(F.col("_slice") < F.col("_last"), F.lit(False))
    edge = F.coalesce(F.col("_slice") == F.col("_last"), F.lit(False))
    order = Window.partitionBy("source").orderBy("_rank", "_mark", "size").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = rows.where(edge).withColumn("_sum", F.col("_before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    at_edge = at_edge.withColumn("_extra", F.when(F.col("_sum") + F.col("size") / 2 <= F.col("_rest"), 1).otherwise(0)).drop("_sum")
    rows = rows.where(~edge).withColumn("_extra", whole_slice.cast("int")).unionByName(at_edge)
    copies = (F.col("_whole") + F.col("_extra")).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", "expected", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "_mark")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix, each row as often as it is taken, with the columns of docs.

    Rows whose doc_id, source and text agree have equal marks; where the sample splits such a group, its copies are dealt out from the
    group's total, so the number of rows is exact.
    """
    plan = mix(docs, **how).groupBy("_mark").agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.xxhash64("doc_id", "source", "text").alias("_m"))
    joined = rows.join(plan, F.col("_m") == F.col("_mark"))
    single = joined.where("_rows = 1").withColumn("_times", F.col("_copies"))
    # Rows that agree in id, source and text, few in practice: their copies are dealt out in turn.
    nth = F.row_number().over(Window.partitionBy("_m").orderBy(F.xxhash64("_row")))
    share = F.floor(F.col("_copies") / F.col("_rows")) + (F.col("_nth") <= F.col("_copies") % F.col("_rows")).cast("long")
    many = joined.where("_rows > 1").withColumn("_nth", nth).withColumn("_times", share).drop("_nth")
    out = single.unionByName(many).where("_times > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))).alias("_n"))
    return out.select("_row.*")
