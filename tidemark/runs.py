"""Jobs and whole runs: from tracks (or images) to track, wave and peak rows, overlays and events, with resume."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import config
from tidemark.operators import grid, kernels, tracing
from tidemark.operators import tracks as T
from tidemark.operators.relational import TRANSITIONS, job_states
from tidemark.sources.stash import stash
from tidemark.sources.store import Batches, EventLog

#: Kinds of events.
CREATED, RENAMED, STATUS, PROGRESS, OVERLAY, CANCEL, ERROR, DONE = "created", "renamed", "status", "progress", "overlay_track", "cancel_requested", "error", "done"


def _json(**fields: Any) -> str:
    return json.dumps(fields, sort_keys=True)


@dataclass
class Jobs:
    """Jobs as a fold over their events: nothing is updated in place, so two writers can't overwrite each other."""

    spark: SparkSession
    root: str

    @property
    def log(self) -> EventLog:
        return EventLog(self.spark, f"{self.root}/events")

    def create_all(self, jobs: DataFrame) -> int | None:
        """Inserts jobs (job_id, owner, run_name, config as JSON text), queued. Ids that exist already, also through a writer who was
        first, are left as they are; repeated ids count once."""
        one = jobs.groupBy("job_id").agg(F.min(F.struct("owner", "run_name", "config")).alias("j"))
        payload = F.to_json(F.struct("j.owner", "j.run_name", "j.config"))
        both = one.select("job_id", F.explode(F.array(
            F.struct(F.lit(0).alias("n"), F.lit(CREATED).alias("type"), payload.alias("payload")), F.struct(F.lit(1).alias("n"), F.lit(STATUS).alias("type"), F.lit(_json(status="queued")).alias("payload")),
        )).alias("e")).select("job_id", "e.*")
        return self.log.append_when(lambda known: both.join(known(CREATED).select("job_id").distinct(), "job_id", "left_anti"), ["n"], (CREATED, STATUS), few=True)

    def say(self, job_id: int, kind: str, tag: str | None = None, **fields: Any) -> int | None:
        row = self.spark.range(1).select(F.lit(job_id).cast("long").alias("job_id"), F.lit(kind).alias("type"), F.lit(_json(**fields)).alias("payload"), F.lit(0).alias("n"))
        return self.log.append(row, ["n"], (kind,), tag, few=True)

    def rename(self, job_id: int, run_name: str) -> None:
        self.get(job_id)
        self.say(job_id, RENAMED, run_name=run_name)

    def table(self) -> DataFrame:
        """job_id, owner, run_name, status, refused (status changes that weren't allowed), cancel_requested."""
        e = self.log.events((CREATED, RENAMED, STATUS, CANCEL))
        text = lambda key: F.get_json_object("payload", f"$.{key}")
        named = e.where(F.col("type").isin(CREATED, RENAMED)).groupBy("job_id").agg(F.max_by(text("run_name"), "seq").alias("run_name"), F.min_by(text("owner"), "seq").cast("long").alias("owner"))
        states = job_states(e.where(F.col("type") == STATUS).select("job_id", "seq", text("status").alias("status")).where("status <> 'queued' or seq > 2"))
        # A request to cancel holds until the job is started again.
        asked = e.where(F.col("type").isin(CANCEL, STATUS)).groupBy("job_id").agg(F.max_by(F.col("type"), "seq").alias("t"), F.max_by(text("status"), "seq").alias("s"))
        out = named.join(states, "job_id", "left").join(asked, "job_id", "left")
        return out.select("job_id", "owner", "run_name", F.coalesce("status", F.lit("queued")).alias("status"), F.coalesce("refused", F.lit(0)).alias("refused"), F.coalesce(F.col("t") == CANCEL, F.lit(False)).alias("cancel_requested"))

    def get(self, job_id: int) -> dict[str, Any]:
        row = self.table().where(F.col("job_id") == job_id).first()
        if row is None:
            raise KeyError(f"no job {job_id}")
        return row.asDict()

    def move(self, job_id: int, status: str) -> None:
        """Changes a job's status, or fails where that isn't allowed."""
        now = self.get(job_id)["status"]
        if status not in TRANSITIONS[now]:
            raise ValueError(f"a job that is {now} can't become {status}")
        self.say(job_id, STATUS, status=status)


def overlays(res: DataFrame, peaks: DataFrame, freq: DataFrame, most: int) -> DataFrame:
    """track_index, poly (array of x, y; at most `most` points), peaks (array of i, x, y, amp), freq_hz, period."""
    point = F.struct("i", F.col("position").alias("x"), F.col("frame").alias("y"))
    poly = T.decimate(res, most).groupBy("track_index").agg(F.transform(F.array_sort(F.collect_list(point)), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("poly"))
    peak = F.struct(F.col("peak_i").alias("i"), F.col("position").alias("x"), F.col("frame").alias("y"), F.col("residual").alias("amp"))
    tops = peaks.groupBy("track_index").agg(F.array_sort(F.collect_list(peak)).alias("peaks"))
    out = poly.join(tops, "track_index", "left").join(freq, "track_index", "left")
    return out.select("track_index", "poly", F.coalesce("peaks", F.array().cast("array<struct<i:int,x:double,y:double,amp:double>>")).alias("peaks"), F.col("frequency").alias("freq_hz"), (1 / F.col("frequency")).alias("period"))


def analyse(tracks: DataFrame, cfg: dict[str, Any], baseline: str = "robust") -> dict[str, DataFrame]:
    """Track, peak and wave rows and overlays of tracks (track_index, i, frame, position), as a configuration asks.

    baseline is robust (random consensus) or line (least squares, with prominence alone as the peaks' threshold).
    """
    rate = float(cfg["io"]["sampling_rate"])
    period, frac = cfg["period"], float(cfg["features"]["fit_window_period_frac"])
    res = stash(kernels.robust_tracks(tracks, **_robust(cfg["detrend"])) if baseline == "robust" else T.detrend(tracks), "run-residuals")
    freq = stash(T.dominant_frequency(res, rate, period.get("min_freq"), period.get("max_freq")), "run-frequencies")
    peaks = stash(kernels.detect(res, cfg["peaks"], freq, rate) if baseline == "robust" else T.find_peaks(res, float(cfg["peaks"]["prominence"])), "run-peaks")
    return {"tracks": T.track_rows(res, peaks, freq, rate), "waves": T.wave_rows(res, peaks, freq, rate, frac), "peaks": T.peak_rows(res, peaks, freq, rate, frac, local=True), "overlays": overlays(res, peaks, freq, int(cfg["overlay"]["max_points"]))}


def _robust(detrend: dict[str, Any]) -> dict[str, Any]:
    names = {"degree": "degree", "max_trials": "trials", "min_samples": "share", "random_state": "seed"}
    return {b: detrend[a] for a, b in names.items() if a in detrend}


def tracks_of_images(images: DataFrame, cfg: dict[str, Any], segment: Callable[[DataFrame], DataFrame], threshold: float = 0.2, least_points: int = 8) -> DataFrame:
    """track_index, i, frame, position, image: the tracks that a segmenter's probabilities show.

    segment turns images (image, y, x, v) into probabilities of the same shape: a network, another program, or a function of pixels. The
    mask goes through the configured morphology and thinning, tracks are harvested through crossings, refined, and left with a point a
    row. Tracks are numbered over all images by image, then by where they begin.
    """
    m = cfg["kymo"]["morphology"]
    prob = stash(segment(images), "run-probabilities")
    mask = prob.withColumn("v", (F.col("v") >= threshold).cast("double"))
    d = m["directional"]
    shaped = grid.morphology(mask, m["mode"], int(d["kv"]), int(d["kh"]), bool(d["diag_bridge"]), int(m["classic"]["kernel"]))
    found = tracing.harvest(grid.thin(shaped.where("v > 0")), least_points)
    # A round's tracks come after those of the rounds before.
    named = stash(found.select("image", (F.col("round").cast("long") * F.lit(1 << 32) + F.col("track")).alias("track"), "y", "x"), "run-harvest")
    points = stash(kernels.collapse(grid.refine(named, prob)), "run-points")
    size = points.groupBy("image", "track").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_points).select("image", "track")
    numbered = number_tracks(size)
    rows = points.join(numbered, ["image", "track"]).select("track_index", F.col("y").cast("double").alias("frame"), F.col("x").cast("double").alias("position"), "image")
    i = F.row_number().over(T.track().orderBy("frame")) - 1
    return rows.select("track_index", i.alias("i"), "frame", "position", "image")


def number_tracks(tracks: DataFrame) -> DataFrame:
    """image, track, track_index: tracks numbered over all images, from how many each image has; no task sorts them all."""
    each = tracks.groupBy("image").agg(F.count(F.lit(1)).alias("n"))
    # One row an image.
    before = F.coalesce(F.sum("n").over(Window.orderBy("image").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy("image").orderBy("track")) - 1
    return tracks.withColumn("_nth", nth).join(each.select("image", before.alias("_before")), "image").select("image", "track", (F.col("_before") + F.col("_nth")).cast("long").alias("track_index"))


class Stopped(RuntimeError):
    """A run was told to die (tests)."""


def run_job(
    jobs: Jobs, job_id: int, tracks: DataFrame, batches: int = 16, over: dict[str, Any] | None = None, baseline: str = "robust", resume: bool = True, stop_after: int | None = None
) -> Batches:
    """Runs a job over tracks (track_index, i, frame, position) to the end, or goes on with one that was stopped.

    Tracks are dealt to `batches` batches by their index; of a job that has begun the number stays what it was. Which batches are
    to do is what the manifest lacks. A batch is one distributed job; its track, wave and peak rows and overlays become visible together.
    Then its overlay events and the progress are appended, under a tag, so that a run that died in between makes up for them, once.
    Between batches a request to cancel is looked for. Without resume all batches are made again, each replacing its old self.

    The job goes in_progress, then completed, cancelled, or failed with the error's text. stop_after batches the run dies as if
    killed, without a word in the log.
    """
    spark, cfg = jobs.spark, config.validate(config.effective(over))
    out = Batches(spark, f"{jobs.root}/jobs/{job_id}")
    jobs.move(job_id, "in_progress") if jobs.get(job_id)["status"] != "in_progress" else None
    try:
        plan = Batches(spark, f"{out.root}/plan")
        if "batches" in plan.done.names():
            batches = plan.done.read("batches")["rows"]["n"]
        else:
            plan.done.put("batches", {"at": "", "rows": {"n": batches}})
        dealt = tracks.withColumn("_batch", F.pmod("track_index", F.lit(batches)).cast("int"))
        todo = stash(dealt.groupBy("_batch").agg(F.count_distinct("track_index").alias("n")), "run-plan")
        total = todo.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        names = F.format_string("b%06d", F.col("_batch"))
        have = out.manifest().where("table = 'tracks'").select(F.col("batch").alias("_name"), "rows")
        left = todo.join(have, names == F.col("_name"), "left_anti") if resume else todo
        done = total - (left.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        for number, row in enumerate(left.orderBy("_batch").collect()):  # one row a batch
            if jobs.get(job_id)["cancel_requested"]:
                jobs.move(job_id, "cancelled")
                return out
            part = stash(dealt.where(F.col("_batch") == row["_batch"]).drop("_batch"), "run-batch")
            out.insert(f"b{row['_batch']:06d}", analyse(part, cfg, baseline))
            if stop_after is not None and number + 1 >= stop_after:
                raise Stopped
            done += row["n"]
            _tell(jobs, job_id, out, f"b{row['_batch']:06d}", done, total)
        for name in sorted(set(out.done.names()) - {t.partition("/")[2] for t in jobs.log.tags() if t.startswith(f"{job_id}/")}):
            _tell(jobs, job_id, out, name, done, total)
        jobs.say(job_id, PROGRESS, stage="completed", processed=total, total=total, eta_secs=0.0)
        jobs.move(job_id, "completed")
        jobs.say(job_id, DONE, ok=True)
    except Stopped:
        raise
    except Exception as e:
        jobs.move(job_id, "failed")
        jobs.say(job_id, ERROR, error=str(e)[:2000])
        raise
    return out


def _tell(jobs: Jobs, job_id: int, out: Batches, batch: str, done: int, total: int) -> None:
    """Appends a batch's overlay events and the progress as one commit, unless its tag is in the log."""
    shown = out.table("overlays").where(F.col("batch") == batch)
    payload = F.to_json(F.struct(*[c for c in shown.columns if c != "batch"]))
    job = F.lit(job_id).cast("long").alias("job_id")
    events = shown.select(job, F.lit(OVERLAY).alias("type"), payload.alias("payload"), "track_index")
    said = jobs.spark.range(1).select(job, F.lit(PROGRESS).alias("type"), F.lit(_json(stage="processing_tracks", processed=done, total=total)).alias("payload"), F.lit(None).cast("long").alias("track_index"))
    # The overlays first, by track, then the progress.
    rows = events.unionByName(said).withColumn("last", F.col("track_index").isNull())
    jobs.log.append(rows, ["last", "track_index"], (OVERLAY, PROGRESS), f"{job_id}/{batch}")


def counts(out: Batches) -> dict[str, int]:
    """Rows done so far by table, from the manifest alone."""
    return {r["table"]: r["n"] for r in out.manifest().groupBy("table").agg(F.sum("rows").alias("n")).collect()}
