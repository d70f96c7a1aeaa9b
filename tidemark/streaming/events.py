"""The event log as a stream: tail, resume, dispatch, latest state, cadences, sessions.

Streams read event files and write Parquet in the shared folder, with the query's checkpoint beside it, so that a restart goes on where
the last run ended and no result passes through the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.sources.stash import shared_dir

#: Event types the viewer tells apart.
TYPES = ("snapshot", "status", "progress", "user_log", "overlay_track", "overlay_ready", "ping")


def event_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """job_id, seq, type, value, ts from the event files of a folder."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").option("recursiveFileLookup", "true")
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
    return reader.parquet(folder).select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("type"), "value", F.col("ts").cast("timestamp").alias("ts"))


def drain(stream: DataFrame, name: str, checkpoint: str | None = None, mode: str = "append", run: str | None = None) -> DataFrame:
    """Runs a stream over all that is there now and returns what it has written.

    checkpoint names a run to go on with. Append streams write straight to files; others write each batch's rows under the batch's
    number, so that a batch that is run again overwrites itself.
    """
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/streams/{name}-{checkpoint or run or uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{at}/rows").outputMode("append").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/rows")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{at}/rows/part_no={number}")

    writer.outputMode(mode).foreachBatch(write).start().awaitTermination()
    return spark.read.parquet(f"{at}/rows").drop("part_no")


def tail(events: DataFrame, after: int) -> DataFrame:
    return events.where(F.col("seq") > after)


def latest_state(events: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the value of the highest seq, kept as state; every change comes out in update mode."""
    return events.groupBy(*keys).agg(F.max("seq").alias("seq"), F.max_by("value", "seq").alias("value"))


def newest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last update of each key over all batches."""
    rest = [c for c in updates.columns if c not in keys]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("u")).select(*keys, "u.*").drop("batch")


def last_batch(results: DataFrame) -> DataFrame:
    """What the last batch of a stream in complete mode has written: all rows as they are now."""
    return results.where(F.col("batch") == results.agg(F.max("batch")).first()[0]).drop("batch")


def by_type(events: DataFrame) -> DataFrame:
    """Events counted by job and type."""
    return events.groupBy("job_id", "type").agg(F.count(F.lit(1)).alias("n"))


def windows(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events per type and tumbling window. In update mode windows come out with each change, the newest too; in append mode only once no
    event within the allowed lateness can still fall in.
    """
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "type", "n", "total")


def sessions(events: DataFrame, late: str = "1 hour", gap: str = "6 hours") -> DataFrame:
    """Events per job and session. Sessions can't be streamed in update mode; in complete mode those that are still open come out too."""
    s = events.withWatermark("ts", late).groupBy("job_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return s.select("job_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def progress(events: DataFrame) -> DataFrame:
    """Per job a map from type to the value of its highest seq: the shallow merge of all progress messages."""
    last = events.groupBy("job_id", "type").agg(F.max_by("value", "seq").alias("v"))
    return last.groupBy("job_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "v")))).alias("progress"))


def paced(events: DataFrame, seconds: float, alpha: float = 0.2) -> DataFrame:
    """job_id, seq, done, rate: at least `seconds` apart, with the events so far and their smoothed rate per second."""
    steps = events.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.col("ts").cast("double").alias("t")))).alias("l"))
    out = "array<struct<seq:bigint,done:int,rate:double>>"
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("t"), F.lit(0).alias("at"), F.lit(None).cast("double").alias("rate"), F.array().cast(out).alias("out"))

    def step(s, x):
        n, gone = s["n"] + 1, x["t"] - s["t"]
        due = s["t"].isNotNull() & (gone >= seconds)
        now = (n - s["at"]) / gone
        rate = F.when(due, F.coalesce(alpha * now + (1 - alpha) * s["rate"], now)).otherwise(s["rate"])
        row = F.struct(x["seq"].alias("seq"), n.alias("done"), rate.alias("rate"))
        fresh = s["t"].isNull() | due
        return F.struct(n.alias("n"), F.when(fresh, x["t"]).otherwise(s["t"]).alias("t"), F.when(fresh, n).otherwise(s["at"]).alias("at"), rate.alias("rate"), F.when(due, F.concat(s["out"], F.array(row))).otherwise(s["out"]).alias("out"))

    folded = steps.select("job_id", F.aggregate("l", start, step, lambda s: s["out"]).alias("o"))
    return folded.select("job_id", F.explode("o").alias("o")).select("job_id", "o.*")


def _in_order(parts: Iterator[pd.DataFrame], columns: list[str]) -> pd.DataFrame:
    """A job's rows of one micro-batch by seq: a few numbers a row, and no more rows than the trigger lets in."""
    return pd.concat([p[columns] for p in parts]).sort_values("seq", kind="stable")


def progress_stream(events: DataFrame) -> DataFrame:
    """job_id, seq, progress as a stream: after each micro-batch the shallow merge of all progress messages of the jobs it touched.

    The state of a job is its merged map with the seq that each entry came from, so that messages which arrive late replace nothing
    newer. Run in update mode; the newest row of a job is what `progress` gives for the whole log.
    """

    def merge(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = json.loads(state.get[0]) if state.exists else {}
        rows = _in_order(parts, ["seq", "type", "value"])
        for seq, kind, value in zip(rows["seq"].tolist(), rows["type"].tolist(), rows["value"].tolist(), strict=True):
            if seq >= known.get(kind, [seq])[0]:
                known[kind] = [seq, value]
        state.update((json.dumps(known),))
        yield pd.DataFrame({"job_id": [key[0]], "seq": [max(s for s, _ in known.values())], "progress": [{k: v for k, (_, v) in sorted(known.items())}]})

    return events.groupBy("job_id").applyInPandasWithState(merge, "job_id long, seq long, progress map<string,double>", "known string", "update", GroupStateTimeout.NoTimeout)


def paced_stream(events: DataFrame, seconds: float, alpha: float = 0.2, idle: str | None = None) -> DataFrame:
    """job_id, seq, done, rate as a stream: what `paced` gives, however the log is cut into micro-batches, as long as a job's events come
    in the order of seq.

    A job's state is four numbers: events so far, time and number of events at the last report, smoothed rate. With idle (such as
    '1 day') the state of a job is dropped once other events are newer than its last one by so much, and events that come later than
    that are left out; else all are kept for ever.
    """

    def pace(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, last, at, rate = state.get if state.exists else (0, None, 0, None)
        rows, out = _in_order(parts, ["seq", "t"]), []
        for seq, t in zip(rows["seq"].tolist(), rows["t"].tolist(), strict=True):
            n += 1
            if last is None:
                last, at = t, n
            elif t - last >= seconds:
                now = (n - at) / (t - last)
                rate = now if rate is None else alpha * now + (1 - alpha) * rate
                last, at = t, n
                out.append((key[0], seq, n, rate))
        state.update((n, last, at, rate))
        if idle:
            state.setTimeoutTimestamp(max(int(1000 * rows["t"].max()), state.getCurrentWatermarkMs()) + 1)
        if out:
            yield pd.DataFrame(out, columns=["job_id", "seq", "done", "rate"])

    timeout = GroupStateTimeout.EventTimeTimeout if idle else GroupStateTimeout.NoTimeout
    timed = (events.withWatermark("ts", idle) if idle else events).withColumn("t", F.col("ts").cast("double"))
    return timed.groupBy("job_id").applyInPandasWithState(pace, "job_id long, seq long, done int, rate double", "n long, t double, at long, rate double", "update", timeout)
