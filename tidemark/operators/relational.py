"""Filters by rules, summaries, and the queries of the run tables."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.stash import stash

NUMBER_FIELDS = {"track_index", "points", "num_peaks", "mean_amplitude", "dominant_frequency", "period"}
TEXT_FIELDS = {"sample"}
COMPARE = {">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}


def number(text: str | None) -> float | None:
    try:
        out = float(text) if text not in (None, "") else None
    except ValueError:
        return None
    return out if out is not None and abs(out) != float("inf") and out == out else None


def rule(field: str, op: str, value: str | None, value2: str | None = None) -> Column:
    """One rule as a predicate.

    An empty or invalid value lets every row pass, as do unknown fields and operators. A null number compares as 0; NaN and infinities
    are dropped. between takes its ends in any order and passes if one is missing. Text is compared without case.
    """
    if field in TEXT_FIELDS:
        want = (value or "").lower()
        got = F.lower(F.coalesce(F.col(field), F.lit("")))
        tests = {"contains": got.contains(want), "==": got == want, "!=": got != want}
        return tests[op] if want and op in tests else F.lit(True)
    if field not in NUMBER_FIELDS:
        return F.lit(True)
    x = F.coalesce(F.col(field).cast("double"), F.lit(0.0))
    sane = ~F.isnan(x) & (F.abs(x) != float("inf"))
    a, b = number(value), number(value2)
    if op == "between":
        return (sane & x.between(min(a, b), max(a, b))) if a is not None and b is not None else F.lit(True)
    return (sane & COMPARE[op](x, F.lit(a))) if op in COMPARE and a is not None else F.lit(True)


def apply_rules(df: DataFrame, rules: list[tuple]) -> DataFrame:
    """Rows that all rules let pass; one filter, which Spark pushes down."""
    return df.where(reduce(and_, [rule(*r) for r in rules], F.lit(True)))


def summary(df: DataFrame) -> DataFrame:
    """Number of tracks, points, mean amplitude and frequency; null counts as 0, NaN and infinities not at all."""
    mean = lambda c: F.avg(F.when(~F.isnan(F.coalesce(F.col(c), F.lit(0.0))), F.coalesce(F.col(c), F.lit(0.0))))
    return df.agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.sum("points"), F.lit(0)).alias("points"), mean("mean_amplitude").alias("avg_amplitude"), mean("dominant_frequency").alias("avg_frequency"))


def latest(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Per key the value of the row that is last by order: an aggregate, so that a key with very many rows is combined where it lies."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def page(df: DataFrame, order: list[Column], skip: int, take: int) -> DataFrame:
    return df.orderBy(*order).offset(skip).limit(take)


def events_after(events: DataFrame, job: int, cursor: int, take: int = 500) -> DataFrame:
    """A job's events after a cursor, in order; job and cursor reach the scan."""
    return events.where((F.col("job_id") == job) & (F.col("seq") > cursor)).orderBy("seq").limit(take)


def next_seq(events: DataFrame) -> DataFrame:
    return events.groupBy("job_id").agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("next_seq"))


def number_events(stored: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """new with a seq that goes on, per job, where the stored events end, without gaps."""
    ends = stored.groupBy("job_id").agg(F.max("seq").alias("_end"))
    nth = F.row_number().over(Window.partitionBy("job_id").orderBy(*order))
    return new.join(ends, "job_id", "left").withColumn("seq", F.coalesce("_end", F.lit(0)) + nth).drop("_end")


def number_many_events(stored: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """As number_events, also for a job of very many events: no task has all of a job's.

    Events are sorted by range over all partitions and written with their places there; a job goes on from one partition to the next by the
    counts of those before, one row a job and partition.
    """
    placed = new.repartitionByRange("job_id", *order).sortWithinPartitions("job_id", *order).withColumn("_at", F.monotonically_increasing_id())
    placed = stash(placed, "events").withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy("job_id", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("job_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = stored.groupBy("job_id").agg(F.max("seq").alias("_end"))
    begins = parts.withColumn("_before", before).join(ends, "job_id", "left").select(
        F.col("job_id").alias("_job"), F.col("_part").alias("_of"), (F.coalesce("_end", F.lit(0)) + F.col("_before") + 1 - F.col("_first")).alias("_begin")
    )
    met = placed.join(begins, F.col("job_id").eqNullSafe(F.col("_job")) & (F.col("_part") == F.col("_of")))
    return met.withColumn("seq", F.col("_begin") + F.col("_at")).drop("_at", "_part", "_job", "_of", "_begin")


def _without(old: Column, more: Column) -> Column:
    return F.map_filter(old, lambda k, v: ~F.map_contains_key(more, k))


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], maps: list[str] = (), replaced: list[str] = ()) -> DataFrame:
    """stored merged with new by key: new values win unless null; maps are merged key by key; `replaced` columns are taken as they come."""
    n = new.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_n_{c}") for c in new.columns if c not in keys], F.lit(True).alias("_new"))
    on = reduce(and_, [F.col(k) == F.col(f"_k_{k}") for k in keys])
    both = stored.join(n, on, "full")
    out = [F.coalesce(k, f"_k_{k}").alias(k) for k in keys]
    for c in stored.columns:
        if c in keys:
            continue
        if c not in new.columns:
            out.append(F.col(c))
        elif c in maps:
            old, more = F.coalesce(c, F.create_map().cast(stored.schema[c].dataType)), F.coalesce(f"_n_{c}", F.create_map().cast(stored.schema[c].dataType))
            out.append(F.map_concat(_without(old, more), more).alias(c))
        elif c in replaced:
            out.append(F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.coalesce(f"_n_{c}", c).alias(c))
    return both.select(*out)


def cascade(job_ids: DataFrame, key: str, **tables: tuple[DataFrame, str]) -> dict[str, DataFrame]:
    """Tables without the rows of the deleted jobs; tables: name = (rows, name of its job column)."""
    return {name: df.join(job_ids.select(F.col(key).alias(c)), c, "left_anti") for name, (df, c) in tables.items()}


#: From which states a job may go where.
TRANSITIONS = {"queued": ["in_progress", "cancelled"], "in_progress": ["completed", "failed", "cancelled"], "failed": ["queued", "in_progress"], "cancelled": ["queued", "in_progress"], "completed": []}


def job_states(log: DataFrame) -> DataFrame:
    """job_id, status, refused: folds each job's requested states in order; a request that isn't allowed is counted and changes nothing."""
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, bs in TRANSITIONS.items() for b in bs])
    steps = log.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("seq", "status"))).alias("log"))
    start = F.struct(F.lit("queued").alias("status"), F.lit(0).alias("refused"))
    step = lambda s, x: F.when(F.array_contains(allowed, F.concat(s["status"], F.lit(">"), x["status"])), F.struct(x["status"].alias("status"), s["refused"].alias("refused"))).otherwise(F.struct(s["status"].alias("status"), (s["refused"] + 1).alias("refused")))
    return steps.select("job_id", F.aggregate("log", start, step).alias("s")).select("job_id", "s.status", "s.refused")


def ema(values: Column, alpha: float) -> Column:
    """Exponential moving average of an array in order; the first value starts it."""
    first = F.get(values, F.lit(0))
    return F.aggregate(values, first, lambda s, x: F.lit(alpha) * x + F.lit(1 - alpha) * s)


def loose_number(fields: Column, key: str) -> Column:
    """A JSON object's field as a finite number, as browsers convert it: null and empty text are 0, true and false 1 and 0, a missing
    field, other text and infinities none. fields is a map of raw texts."""
    raw = F.trim(F.element_at(fields, key))
    plain = F.when(raw.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), raw.try_cast("double"))
    value = F.when(raw.isNull() | (raw == ""), F.lit(0.0)).when(raw == "true", 1.0).when(raw == "false", 0.0).otherwise(plain)
    return F.when(F.map_contains_key(fields, key) & (F.abs(value) < float("inf")), value)


def overlay_tracks(payload: Column) -> Column:
    """A track event's JSON text as a struct: track_index, sample, poly, peaks, mean_amplitude, dominant_frequency, period, num_peaks.

    Points without two finite coordinates go, as do entries that aren't objects; the mean is over the amplitudes of the peaks that stay.
    Null if the text isn't an object or has no finite track_index.
    """
    parsed = lambda c, kind: F.from_json(c, kind)
    top = parsed(payload, "map<string,string>")
    entries = lambda key: F.coalesce(F.transform(parsed(F.element_at(top, key), "array<string>"), lambda e: parsed(e, "map<string,string>")), F.array().cast("array<map<string,string>>"))
    point = lambda m: F.struct(loose_number(m, "x").alias("x"), loose_number(m, "y").alias("y"))
    peak = lambda m: F.struct(loose_number(m, "x").alias("x"), loose_number(m, "y").alias("y"), loose_number(m, "amp").alias("amp"))
    placed = lambda p: p["x"].isNotNull() & p["y"].isNotNull()
    poly, peaks = F.filter(F.transform(entries("poly"), point), placed), F.filter(F.transform(entries("peaks"), peak), placed)
    amps = F.filter(F.transform(peaks, lambda p: p["amp"]), lambda a: a.isNotNull())
    mean = F.when(F.size(amps) > 0, F.aggregate(amps, F.lit(0.0), lambda s, a: s + a) / F.size(amps))
    index = loose_number(top, "track_index")
    return F.when(index.isNotNull(), F.struct(
        index.alias("track_index"), F.element_at(top, "sample").alias("sample"), poly.alias("poly"), peaks.alias("peaks"), mean.alias("mean_amplitude"),
        loose_number(top, "freq_hz").alias("dominant_frequency"), loose_number(top, "period").alias("period"), F.size(peaks).alias("num_peaks"),
    ))
