"""Queries without SQL give what plain versions give over all rows of the small tables."""

from collections import defaultdict
from datetime import timedelta

import pytest

from tidemark import plans
from tidemark.streaming import events as E

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    rows = spark.read.parquet(f"{SMALL}/events.parquet").selectExpr("event_id", "user_id", "event_type", "value", "CAST(ts AS timestamp) AS ts").collect()
    return sorted(rows, key=lambda r: r["event_id"])


def sessions(events, gap=timedelta(hours=6)):
    times, out = defaultdict(list), []
    for r in events:
        times[r["user_id"]].append(r["ts"])
    for user, ts in times.items():
        ts.sort()
        at = 0
        for k in range(1, len(ts) + 1):
            if k == len(ts) or ts[k] - ts[k - 1] > gap:
                out.append((user, ts[at], ts[k - 1] + gap, k - at))
                at = k
    return sorted(out)


def test_sample_ids_of_all_customers(spark):
    want = {}
    for r in spark.read.parquet(f"{SMALL}/customer.parquet").collect():
        h = 2166136261
        for c in r["c_name"]:
            h = (h ^ ord(c)) * 16777619 % (1 << 32)
        want[r["c_custkey"]] = h % 10_000_000
    assert max(want) > 100
    assert {r["c_custkey"]: r["sample_id"] for r in plans.queries()["h6_sample_id_all"](spark, SMALL).collect()} == want


def test_rates_of_all_users(spark, events):
    want = {}
    for r in events:
        want[r["user_id"]] = 0.2 * r["value"] + 0.8 * want[r["user_id"]] if r["user_id"] in want else r["value"]
    assert max(want) >= 5
    assert {r["user_id"]: r["rate"] for r in plans.queries()["e21_ema_rate_all"](spark, SMALL).collect()} == pytest.approx(want, abs=2e-6)


def test_windows_count_all_events(spark, events):
    n, total = defaultdict(int), defaultdict(float)
    for r in events:
        key = r["ts"].replace(hour=0, minute=0, second=0, microsecond=0), r["event_type"]
        n[key] += 1
        total[key] += r["value"]
    got = plans.queries()["k_window_counts"](spark, SMALL).selectExpr("CAST(start AS timestamp_ntz) AS start", "type", "n", "total").collect()
    assert len(got) == len(n) and sum(r["n"] for r in got) == len(events)
    assert {(r["start"], r["type"]): r["n"] for r in got} == {(a, b): k for (a, b), k in n.items()}
    assert all(r["total"] == pytest.approx(total[r["start"], r["type"]], abs=1e-5) for r in got)


def test_sessions_count_all_events(spark, events):
    got = plans.queries()["k_session_windows"](spark, SMALL).collect()
    assert sum(r["n"] for r in got) == len(events)
    assert sorted((r["job_id"], r["start"], r["end"], r["n"]) for r in got) == sessions(events)


def test_results_over_several_batches(spark, events, tmp_path):
    """Two files in order of time, one a batch: changed windows and sessions come out once, as they are at the end."""
    log = spark.read.parquet(f"{SMALL}/events.parquet").orderBy("ts", "event_id").toPandas()
    half = len(log) // 2
    for name, part in (("events", log[:half]), ("events_more", log[half:])):
        spark.createDataFrame(part, spark.read.parquet(f"{SMALL}/events.parquet").schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    stream = lambda: spark.readStream.schema(spark.read.parquet(f"{SMALL}/events.parquet").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "*.parquet")).selectExpr("user_id AS job_id", "event_id AS seq", "event_type AS type", "value", "CAST(ts AS timestamp) AS ts")
    done = E.newest(E.drain(E.windows(stream(), late="400 days"), "windows", mode="update"), ["start", "type"])
    assert done.groupBy().sum("n").first()[0] == len(events) and done.count() == done.select("start", "type").distinct().count()
    done = E.last_batch(E.drain(E.sessions(stream()), "sessions", mode="complete"))
    assert sorted((r["job_id"], r["start"], r["end"], r["n"]) for r in done.collect()) == sessions(events)
