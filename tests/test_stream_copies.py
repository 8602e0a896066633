"""The join of two streams, requests and robots copies, over files in any order."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators.robots import ROBOTS_TTL_SECONDS, fresh_snapshot
from pagemill.streaming import copies

BASE = 1_700_000_000


def put(spark, folder, rows, schema, time):
    made = spark.createDataFrame([(*r[:-1], (BASE + r[-1]) * 1_000_000) for r in rows], f"{schema}, us long")
    made.withColumn(time, F.timestamp_micros("us")).drop("us").coalesce(1).write.mode("append").parquet(folder)


def streams(spark, tmp_path, requests, held, files):
    """Both sides dealt to files, each file a micro-batch of its own."""
    for i in range(files):
        put(spark, str(tmp_path / "q"), requests[i::files], "request_id long, domain string", "event_at")
        put(spark, str(tmp_path / "c"), held[i::files], "domain string, content string", "fetched_at")
    return [
        spark.readStream.schema(spark.read.parquet(str(tmp_path / side)).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / side))
        for side in "qc"
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_the_batch_form_whatever_the_order(spark, tmp_path, seed):
    r = random.Random(seed)
    # One domain has most of both sides.
    name = lambda: r.choice(["hot", "hot", "hot", "a", "b", "none", None])
    requests = [(i, name(), r.randrange(0, 300_000)) for i in range(150)]
    held = [(d, f"{d} {at}", at) for d, at in ((r.choice(["hot", "hot", "a", "b", None]), r.randrange(0, 300_000)) for _ in range(40))]
    r.shuffle(requests)
    asked, kept = streams(spark, tmp_path, requests, held, 3)
    found = copies.run_to_end(asked, kept, "t-copies", "content", late="4 days").collect()
    timed = spark.createDataFrame([(i, d, (BASE + at) * 1_000_000) for i, d, at in requests], "request_id long, domain string, arrival_us long")
    shots = spark.createDataFrame([(d, (BASE + at) * 1_000_000) for d, _, at in held], "domain string, fetched_us long")
    expected = {x["request_id"]: x["snapshot_us"] if x["domain"] else None for x in fresh_snapshot(timed, shots).collect()}
    assert {x["request_id"]: x["snapshot_us"] for x in found} == expected and len(found) == len(requests)
    for x in found:
        assert x["content"] == (None if x["snapshot_us"] is None else f"{x['domain']} {x['snapshot_us'] // 1_000_000 - BASE}")


def test_bounds_ties_repeats_and_no_copies(spark, tmp_path):
    held = [("d", "x", 0), ("d", "x", 0)]
    requests = [(1, "d", 0), (2, "d", ROBOTS_TTL_SECONDS - 1), (3, "d", ROBOTS_TTL_SECONDS), (4, "e", 5), (5, "d", 1), (5, "d", 1), (None, "d", 2)]
    asked, kept = streams(spark, tmp_path, requests, held, 1)
    found = {x["request_id"]: x["snapshot_us"] for x in copies.run_to_end(asked, kept, "t-bounds").collect()}
    at = BASE * 1_000_000
    assert found == {1: at, 2: at, 3: None, 4: None, 5: at, None: at}


def test_empty_inputs(spark, tmp_path):
    asked, kept = streams(spark, tmp_path, [], [], 1)
    assert copies.run_to_end(asked, kept, "t-empty").count() == 0


def test_state_ends_with_the_watermark(spark, tmp_path):
    """Once both streams are days ahead, neither an old request nor an old copy is held any more."""
    days = 86_400
    requests = [(i, "d", i) for i in range(50)] + [(100, "e", 9 * days), (101, "e", 9 * days + 1)]
    held = [("d", "x", i) for i in range(20)] + [("e", "y", 9 * days), ("e", "y", 9 * days + 1)]
    put(spark, str(tmp_path / "q"), requests[:50], "request_id long, domain string", "event_at")
    put(spark, str(tmp_path / "c"), held[:20], "domain string, content string", "fetched_at")
    sides = [spark.readStream.schema(spark.read.parquet(str(tmp_path / side)).schema).parquet(str(tmp_path / side)) for side in "qc"]
    rows = copies.newest_copy_stream(*sides, slices=2)

    def run():
        query = (
            rows.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"])

    assert run() > 50
    put(spark, str(tmp_path / "q"), requests[50:], "request_id long, domain string", "event_at")
    put(spark, str(tmp_path / "c"), held[20:], "domain string, content string", "fetched_at")
    # What is left: two requests, and two copies in each of two slices; met requests wait in the count as well.
    assert run() <= 2 + 2 * 2 + 2
    assert spark.read.parquet(str(tmp_path / "out")).filter("request_id < 50").count() == 50
