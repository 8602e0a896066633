"""The status machine and the kept counters over several files, late and replayed ones included."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from pagemill.operators import rollups
from pagemill.plans.scratch import scratch_path
from pagemill.streaming import fresh, jobs, machine

SECOND = 1_000_000
BASE = 10_000_000 * SECOND


def put(spark, folder, events):
    rows = spark.createDataFrame([(k, s, BASE + at * SECOND) for k, s, at in events], "crawl_id string, status string, us long")
    rows.select("crawl_id", "status", F.timestamp_micros("us").alias("event_at")).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    schema = "crawl_id string, status string, event_at timestamp"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def told(found):
    return [((r["event_us"] - BASE) // SECOND, r["status"], r["from_status"], r["legal"]) for r in found]


def test_only_legal_changes_are_taken(spark, tmp_path):
    batches = [
        [("a", "processing", 1), ("a", "pending", 0), ("b", "completed", 5)],
        [("a", "completed", 9), ("a", "processing", 10), ("b", "pending", 6)],
        [("a", "pending", 9 + 3599), ("b", "pending", 4), (None, "pending", 3500)],
        [("a", "pending", 9 + 3600), ("b", "processing", 3610), ("b", None, 3611), ("b", "odd", 3612)],
        [("b", "failed", 3700), ("b", "retry", 3701), ("b", "processing", 3702), ("b", "processing", 3702 + 86_400)],
    ]
    for events in batches:
        put(spark, str(tmp_path), events)
    found = jobs.run_to_files(machine.checked_status_stream(stream(spark, str(tmp_path)), late="4 hours"), "t-machine")
    rows = sorted(found.collect(), key=lambda r: (r["crawl_id"] or "", r["event_us"]))
    assert told(r for r in rows if r["crawl_id"] == "a") == [
        (0, "pending", None, True), (1, "processing", "pending", True), (9, "completed", "processing", True),
        (10, "processing", "completed", False), (3608, "pending", "completed", False), (3609, "pending", None, True),
    ]
    assert told(r for r in rows if r["crawl_id"] == "b") == [
        (4, "pending", "pending", False), (5, "completed", None, False), (6, "pending", None, True),
        (3610, "processing", "pending", True), (3611, "", "processing", False), (3612, "odd", "processing", False),
        (3700, "failed", "processing", True), (3701, "retry", "failed", True), (3702, "processing", "retry", True),
        (3702 + 86_400, "processing", None, False),
    ]
    assert told(r for r in rows if r["crawl_id"] is None) == [(3500, "pending", None, True)]


def test_state_is_cleared_by_event_time(spark, tmp_path):
    put(spark, str(tmp_path / "in"), [(f"k{i}", "pending", i) for i in range(50)])
    put(spark, str(tmp_path / "in"), [("end", "odd", 300_000)])
    put(spark, str(tmp_path / "in"), [("end", "odd", 300_001)])
    rows = machine.checked_status_stream(stream(spark, str(tmp_path / "in")))
    query = rows.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    held = [p["stateOperators"][0]["customMetrics"].get("numValueStateVars") for p in query.recentProgress if p["stateOperators"]]
    removed = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert held and removed[-1] < max(removed) and removed[-1] <= 4


def test_windows_all_come_out(spark, tmp_path):
    r = random.Random(2)
    events = [(f"k{r.randrange(5)}", "pending", at) for at in range(0, 400, 3)]
    for part in range(0, len(events), 30):
        put(spark, str(tmp_path), events[part : part + 30])
    counts = jobs.run_updates(jobs.metric_stream(stream(spark, str(tmp_path)), "crawl_id", late="30 seconds"), "t-windows", "window_start", "crawl_id")
    found = {(r["us"], r["crawl_id"]): r["events"] for r in counts.select(F.unix_micros("window_start").alias("us"), "crawl_id", "events").collect()}
    want: dict = {}
    for k, _, at in events:
        us = (BASE + at * SECOND) // (15 * SECOND) * 15 * SECOND
        want[us, k] = want.get((us, k), 0) + 1
    assert found == want


FETCHES = "domain string, status string, status_code int, response_time_ms int, event_at timestamp"


def fetches(spark, seed, count):
    r = random.Random(seed)
    made = [(r.choice(["a", "b", "", None]), r.choice(["completed", "failed"]), r.choice([200, 404, None]), r.choice([5, 300, 20_000, None]), BASE // SECOND + r.randrange(9999)) for _ in range(count)]
    rows = spark.createDataFrame(made, "domain string, status string, status_code int, response_time_ms int, at long")
    return rows.withColumn("event_at", F.timestamp_seconds("at")).drop("at")


def test_kept_counters_equal_one_scan_after_a_replay(spark):
    path, merged = scratch_path(spark, "sums"), scratch_path(spark, "sums")
    parts = [fetches(spark, n, 200) for n in range(3)]
    for n in (0, 1, 2, 1):
        rollups.keep_batch(parts[n], path, n)
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    want = sorted(map(tuple, rollups.partial_sums(whole).collect()))
    assert sorted(map(tuple, rollups.kept_totals(spark, path, *rollups.LABELS).collect())) == want
    rollups.merge_batches(spark, path, merged)
    assert spark.read.parquet(merged).count() == len(want)
    assert sorted(map(tuple, rollups.kept_totals(spark, merged, *rollups.LABELS).collect())) == want
    total = rollups.kept_totals(spark, path).first()
    assert (total["fetches"], total["ms_count"]) == (600, whole.filter("response_time_ms is not null").count())
    by_domain = {r["domain"]: r["fetches"] for r in rollups.kept_totals(spark, path, "domain").collect()}
    assert set(by_domain) == {"a", "b", "unknown"} and sum(by_domain.values()) == 600
    rollups.keep_batch(spark.createDataFrame([], FETCHES), path, 1)
    assert rollups.kept_totals(spark, path).first()["fetches"] == 400


def test_fresh_results_share_the_state_of_their_bucket(spark, tmp_path):
    r = random.Random(3)
    made = [[(r.choice([None, *(f"k{i}" for i in range(300))]), "x", part * 3000 + r.randrange(6000)) for _ in range(900)] for part in range(3)]
    for events in made:
        put(spark, str(tmp_path / "in"), events)
    rows = fresh.fresh_result_stream(stream(spark, str(tmp_path / "in")).select("crawl_id", "event_at"), late="4 hours", buckets=8)
    found = jobs.run_to_files(rows, "t-fresh").collect()
    want, kept = set(), {}
    for events in made:
        for at, name in sorted((at, name or "") for name, _, at in events):
            if name not in kept or at >= kept[name] + 3600:
                kept[name] = at
                want.add((name, at))
    assert {(f["crawl_id"] or "", int(f["event_at"].timestamp()) - BASE // SECOND) for f in found} == want and len(found) == len(want)
    query = fresh.fresh_result_stream(
        stream(spark, str(tmp_path / "in")).select("crawl_id", "event_at"), late="4 hours", buckets=8
    ).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) < 300
