"""The batch store, the event log under several writers, jobs, and runs that die and resume."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark import runs
from tidemark.operators import tracks as T
from tidemark.sources import store


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}"


def events(spark, *rows):
    return spark.createDataFrame([(j, k, "{}", n) for n, (j, k) in enumerate(rows)], "job_id long, type string, payload string, n int")


def test_a_batch_sent_twice_is_there_once(spark, root):
    b = store.Batches(spark, root)
    with pytest.raises(ValueError):
        b.table("tracks")
    assert b.table("tracks", "id long").count() == 0 and b.manifest().count() == 0
    b.insert("a-1", {"tracks": spark.range(5), "waves": spark.range(7)})
    b.insert("a-2", {"tracks": spark.range(5, 9)})
    b.insert("a-1", {"tracks": spark.range(3), "waves": spark.range(0)})
    assert {(r["id"], r["batch"]) for r in b.table("tracks").collect()} == {(i, "a-1") for i in range(3)} | {(i, "a-2") for i in range(5, 9)}
    assert {tuple(r) for r in b.manifest().collect()} == {("a-1", "tracks", 3), ("a-1", "waves", 0), ("a-2", "tracks", 4)} and b.table("waves").count() == 0
    assert len(store.Folder(spark, f"{root}/rows").names()) == 2


def test_rows_of_a_writer_that_died_are_not_seen(spark, root):
    b = store.Batches(spark, root)
    b.insert("x", {"t": spark.range(2)})
    spark.range(9).write.parquet(f"{root}/rows/x-{'0' * 32}/t")
    assert b.table("t").count() == 2


def test_claims_are_exclusive(spark, root):
    f = store.Folder(spark, f"{root}/log")
    assert f.names() == [] and f.claim("1", {"a": 1}) and not f.claim("1", {"a": 2}) and f.read("1") == {"a": 1}
    f.put("1", {"a": 3})
    assert f.read("1") == {"a": 3} and f.names() == ["1"]


def test_two_writers_number_without_gaps(spark, root):
    """Each time one has numbered its events, the other writes first."""
    log = store.EventLog(spark, root)
    log.append(events(spark, (1, "a"), (2, "a"), (1, "b")), ["n"], ("a", "b"))
    tries = []

    def other():
        tries.append(1)
        if len(tries) < 3:
            log.append(events(spark, (1, "other"), (3, "other")), ["n"], ("other",))

    assert log.append(events(spark, (1, "mine"), (1, "mine"), (2, "mine")), ["n"], ("mine",), before=other) == 3
    got = {}
    for r in log.events().orderBy("seq").collect():
        got.setdefault(r["job_id"], []).append((r["seq"], r["type"]))
    assert got == {1: [(1, "a"), (2, "b"), (3, "other"), (4, "other"), (5, "mine"), (6, "mine")], 2: [(1, "a"), (2, "mine")], 3: [(1, "other"), (2, "other")]}
    assert len(store.Folder(spark, f"{root}/rows").names()) == 4 and log.events(("other",)).count() == 4


def test_gives_up_after_five_tries(spark, root):
    log = store.EventLog(spark, root)
    with pytest.raises(store.Conflict):
        log.append(events(spark, (1, "mine")), ["n"], ("mine",), before=lambda: log.append(events(spark, (1, "other")), ["n"], ("other",)))
    assert [r["seq"] for r in log.events().orderBy("seq").collect()] == [1, 2, 3, 4, 5]


def test_a_tag_is_committed_once(spark, root):
    log = store.EventLog(spark, root)
    assert log.append(events(spark, (1, "a")), ["n"], ("a",), "t") == 0 and log.append(events(spark, (1, "a")), ["n"], ("a",), "t") is None
    assert log.events().count() == 1 and log.tags() == {"t"}


def jobs_of(spark, root, *ids):
    jobs = runs.Jobs(spark, root)
    jobs.create_all(spark.createDataFrame([(i, 7, f"run {i}", "{}") for i in ids], "job_id long, owner long, run_name string, config string"))
    return jobs


def test_jobs(spark, root):
    jobs = jobs_of(spark, root, 1, 2, 2)
    jobs_of(spark, root, 2, 3)
    assert {r["job_id"]: r["run_name"] for r in jobs.table().collect()} == {1: "run 1", 2: "run 2", 3: "run 3"}
    assert jobs.log.events().where("job_id = 2").count() == 2
    jobs.rename(2, "other")
    assert jobs.get(2) == {"job_id": 2, "owner": 7, "run_name": "other", "status": "queued", "refused": 0, "cancel_requested": False}
    with pytest.raises(KeyError):
        jobs.rename(9, "x")
    jobs.move(2, "in_progress")
    with pytest.raises(ValueError):
        jobs.move(2, "queued")
    jobs.say(2, runs.CANCEL)
    assert jobs.get(2)["cancel_requested"] and jobs.get(2)["status"] == "in_progress"


@pytest.fixture(scope="module")
def tracks(spark):
    import math

    rows = [(t, i, float(i), 5 * math.sin(i / (2 + t % 3)) + 0.1 * t * i) for t in range(9) for i in range(40 + t)]
    return spark.createDataFrame(rows, "track_index long, i int, frame double, position double")


LINE = {"peaks": {"prominence": 1.0}, "period": {"min_freq": 0.02, "max_freq": 0.45}}


def rows(df):
    plain = lambda v: round(v, 9) + 0.0 if isinstance(v, float) else [plain(x) for x in v] if isinstance(v, (list, tuple)) else v
    return sorted(str(plain(tuple(r))) for r in df.drop("batch").collect())


def test_a_killed_run_resumes_to_the_same_tables(spark, root, tracks):
    jobs = jobs_of(spark, root, 1, 2)
    whole = runs.run_job(jobs, 1, tracks, 3, LINE, "line")
    with pytest.raises(runs.Stopped):
        runs.run_job(jobs, 2, tracks, 3, LINE, "line", stop_after=2)
    half = runs.counts(store.Batches(spark, f"{root}/jobs/2"))
    assert 0 < half["tracks"] < 9 and jobs.get(2)["status"] == "in_progress"
    part = runs.run_job(jobs, 2, tracks, 99, LINE, "line")
    for name in ("tracks", "waves", "peaks", "overlays"):
        assert rows(whole.table(name)) == rows(part.table(name)), name
    assert jobs.get(1)["status"] == jobs.get(2)["status"] == "completed"
    assert runs.counts(whole)["tracks"] == 9 and len(part.done.names()) == 3
    for job in (1, 2):
        e = jobs.log.events().where(F.col("job_id") == job).orderBy("seq").collect()
        assert [r["seq"] for r in e] == list(range(1, len(e) + 1))
        shown = [json.loads(r["payload"])["track_index"] for r in e if r["type"] == runs.OVERLAY]
        assert sorted(shown) == list(range(9))
        last = [json.loads(r["payload"]) for r in e if r["type"] == runs.PROGRESS][-1]
        assert last == {"stage": "completed", "processed": 9, "total": 9, "eta_secs": 0.0} and e[-1]["type"] == runs.DONE


def test_the_run_equals_its_operators(spark, root, tracks):
    out = runs.run_job(jobs_of(spark, root, 1), 1, tracks, 2, LINE, "line")
    res = T.detrend(tracks)
    want = T.track_rows(res, T.find_peaks(res, 1.0), T.dominant_frequency(res, 1.0, 0.02, 0.45), 1.0)
    assert rows(out.table("tracks")) == rows(want)


def test_cancel_and_failure(spark, root, tracks):
    jobs = jobs_of(spark, root, 1, 2)
    jobs.move(1, "in_progress")
    jobs.say(1, runs.CANCEL)
    out = runs.run_job(jobs, 1, tracks, 2, LINE, "line")
    assert jobs.get(1)["status"] == "cancelled" and out.manifest().count() == 0
    runs.run_job(jobs, 1, tracks, 2, LINE, "line")
    assert jobs.get(1)["status"] == "completed"
    with pytest.raises(Exception, match="position"):
        runs.run_job(jobs, 2, tracks.drop("position"), 2, LINE, "line")
    assert jobs.get(2)["status"] == "failed" and jobs.log.events((runs.ERROR,)).count() == 1


def test_run_over_no_tracks_and_robust_run(spark, root, tracks):
    jobs = jobs_of(spark, root, 1, 2)
    out = runs.run_job(jobs, 1, tracks.where("1 = 0"), 2, LINE, "line")
    assert jobs.get(1)["status"] == "completed" and out.manifest().count() == 0
    out = runs.run_job(jobs, 2, tracks.where("track_index < 2"), 1)
    assert out.table("tracks").count() == 2 and out.table("peaks").count() >= 2


def test_tracks_of_images(spark):
    """Two crossing lines, found by a segmenter that is a function of pixels."""
    h, w = 40, 40
    lit = {(y, y // 2 + 5) for y in range(h)} | {(y, 25 - y // 2) for y in range(h)}
    img = spark.createDataFrame([(3, y, x, 0.9 if (y, x) in lit else 0.0) for y in range(h) for x in range(w)], "image long, y int, x int, v double")
    cfg = runs.config.effective({"kymo": {"morphology": {"mode": "none"}}})
    got = runs.tracks_of_images(img, cfg, lambda p: p)
    tracks = {}
    for r in got.orderBy("i").collect():
        tracks.setdefault(r["track_index"], []).append((r["frame"], r["position"]))
    assert len(tracks) >= 2 and max(len(t) for t in tracks.values()) >= 30
    near = lambda y, x: min(abs(x - (y // 2 + 5)), abs(x - (25 - y // 2))) <= 1
    assert all(near(y, x) for t in tracks.values() for y, x in t)
