"""Plans with a dominant key, against sequential Python."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.operators.robots import fresh_snapshot
from pagemill.operators.schedule import domain_stats, polite_schedule, rate_limited
from pagemill.plans.ordered import CHUNK, into_chunks, running_max
from pagemill.plans.skew import spread_join
from pagemill.streaming.polite import advance

SECOND = 1_000_000


def arrivals(seed, n=600):
    """Two thirds of the rows in one domain, a block of them at one instant."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        domain = "hot" if rng.random() < 0.67 else rng.choice([None, "d1", "d2", "d3", "d4"])
        at = 50 * SECOND if rng.random() < 0.3 else rng.randrange(0, 4000) * SECOND // 10
        rows.append((i, domain, at, rng.choice([None, 0.5, 1.0, 2.0])))
    return rows


def sequential(rows, stored=None):
    state, out = {}, {}
    for rid, domain, at, delay in sorted(rows, key=lambda r: (r[2], r[0])):
        last, count, held = state.get(domain, (None, 0, None))
        if held is None:
            held = round(((stored or {}).get(domain) or delay or 1.0) * SECOND)
        start = at if last is None else max(at, last + held)
        state[domain] = (start, count + 1, held)
        out[rid] = (start, count + 1, held)
    return out


@pytest.mark.parametrize("seed, chunks", [(1, 1), (2, 7), (3, 40)])
def test_schedule_equals_the_sequential_loop(spark, seed, chunks):
    rows = arrivals(seed)
    df = spark.createDataFrame(rows, "request_id long, domain string, arrival_us long, crawl_delay double")
    found = {r.request_id: (r.start_us, r.request_number, r.delay_us) for r in polite_schedule(df, chunks=chunks).collect()}
    assert found == sequential(rows)


def test_schedule_with_stored_delays(spark):
    rows = arrivals(9)
    df = spark.createDataFrame(rows, "request_id long, domain string, arrival_us long, crawl_delay double")
    stored = {"hot": 3.0, "d1": 0.1, "unseen": 9.0}
    settings = spark.createDataFrame(list(stored.items()), "domain string, crawl_delay double")
    plan = polite_schedule(df, settings, chunks=9)
    found = {r.request_id: (r.start_us, r.request_number, r.delay_us) for r in plan.collect()}
    assert found == sequential(rows, stored)
    last = {r.domain: r for r in domain_stats(plan).collect()}
    assert last["hot"].request_count == sum(r[1] == "hot" for r in rows)
    probe = last["hot"].last_start_us + 3 * SECOND
    assert {r.domain: r.is_limited for r in rate_limited(domain_stats(plan), probe - 1).collect()}["hot"]
    assert not {r.domain: r.is_limited for r in rate_limited(domain_stats(plan), probe).collect()}["hot"]


def test_a_hot_key_spans_many_chunks(spark):
    df = spark.range(4000).select(F.lit("hot").alias("k"), F.lit(5).alias("t"), "id")
    cut = into_chunks(df, "k", ["t", "id"], 8)
    sizes = [r["count"] for r in cut.groupBy(CHUNK).count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 1500


def test_running_max(spark):
    rng = random.Random(4)
    rows = [(i, "hot" if i % 3 else f"k{i % 5}", rng.randrange(50), rng.choice([None, rng.randrange(1000)])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k string, t long, v long")
    found = {r.id: r.top for r in running_max(df, "k", ["t", "id"], "v", "top", 9).collect()}
    best, expected = {}, {}
    for i, k, t, v in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        best[k] = max((x for x in (best.get(k), v) if x is not None), default=None)
        expected[i] = best[k]
    assert found == expected


def test_fresh_snapshot_equals_brute_force(spark):
    rng = random.Random(6)
    day = 86_400 * SECOND
    requests = [(i, rng.choice(["hot", "hot", "a", "none"]), rng.randrange(0, 10 * day)) for i in range(300)]
    snaps = [(rng.choice(["hot", "a"]), rng.randrange(0, 10 * day, day // 3)) for _ in range(40)]
    requests += [(1000, "edge", day), (1001, "edge", day - 1), (1002, "edge", 0)]
    snaps += [("edge", 0)]
    found = fresh_snapshot(
        spark.createDataFrame(requests, "request_id long, domain string, arrival_us long"),
        spark.createDataFrame(snaps, "domain string, fetched_us long"),
        chunks=7,
    )
    got = {r.request_id: r.snapshot_us for r in found.collect()}
    want = {
        i: max((f for s, f in snaps if s == d and f <= t < f + day and f == max(g for e, g in snaps if e == d and g <= t)), default=None)
        for i, d, t in requests
    }
    assert got == want


@pytest.mark.parametrize("hot_rows", [10, 10_000])
def test_spread_join_equals_a_plain_join(spark, hot_rows):
    big = spark.range(900).select(
        "id", F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 5 > 0, F.concat(F.lit("k"), F.col("id") % 7)).alias("k")
    )
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k6", 4), (None, 5)], "k string, v int")
    for how in ("left", "inner"):
        found = spread_join(big, small, ["k"], "id", how, hot_rows)
        assert sorted(found.select("id", "k", "v").collect(), key=str) == sorted(
            big.join(small, ["k"], how).select("id", "k", "v").collect(), key=str
        )


def lapsing(arrivals_us, delays, ttl):
    last = count = held = None
    out = []
    for a, d in zip(arrivals_us, delays):
        if last is None or a >= last + ttl:
            held, count, start = d, 0, a
        else:
            start = max(a, last + held)
        last, count = start, count + 1
        out.append((start, count, held))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_streaming_state_equals_the_sequential_loop(seed):
    rng = np.random.default_rng(seed)
    gaps = rng.choice([0, 1, 5, 30, 101, 400], size=500)
    a, d, ttl = np.cumsum(gaps).astype(np.int64), rng.choice([2, 7, 20], size=500).astype(np.int64), 100
    expected = lapsing(a.tolist(), d.tolist(), ttl)
    state, found = None, []
    for part in np.array_split(np.arange(500), 6):
        starts, numbers, used, state = advance(a[part], d[part], state, ttl)
        found += list(zip(starts.tolist(), numbers.tolist(), used.tolist()))
    assert found == expected
