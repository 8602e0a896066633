"""What the plans look like: no shuffle where none is needed, pruned scans, top-k before shuffles."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from pagemill.catalog import stand_ins as D
from pagemill.operators import extract as E
from pagemill.operators import queue, results, topics
from pagemill.plans.pipeline import page_metadata
from pagemill.sources.tables import read_table

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_page_metadata_is_one_narrow_stage(spark):
    rows = read_table(spark, FOLDER, "pages").select(
        F.col("page_id").cast("string").alias("crawl_id"), "url", "html", F.lit(200).alias("status_code"),
        F.create_map(F.lit("content-type"), F.lit("text/html")).alias("response_headers"),
        F.lit(1).alias("response_time_ms"), F.current_timestamp().alias("fetched_at"),
    )
    plan = plan_of(page_metadata(rows))
    assert "Exchange" not in plan and "Python" not in plan


def test_unused_fields_cost_nothing(spark):
    plan = plan_of(E.extract(read_table(spark, FOLDER, "pages")).select("page_id", "domain"))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan


def test_listing_is_a_top_k(spark):
    stored = read_table(spark, FOLDER, "orders").select(
        F.col("o_orderkey").cast("string").alias("crawl_id"), F.col("o_orderdate").alias("created_at"),
        F.col("o_orderstatus").alias("status"),
    )
    plan = plan_of(results.list_results(stored, status="F"))
    assert "TakeOrderedAndProject" in plan and "EqualTo(o_orderstatus,F)" in plan


def test_per_domain_top_k_cuts_before_the_shuffle(spark):
    plan = plan_of(queue.next_due(D.queue(spark, FOLDER), 10, per_domain=2))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_only_hits_are_shuffled(spark):
    matches = topics.match_keywords(read_table(spark, FOLDER, "documents"), "doc_id")
    plan = plan_of(topics.score_topics(matches, "doc_id"))
    assert plan.count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_the_schedule_shuffles_its_rows_once(spark):
    from pagemill.catalog.requests import polite_schedule

    df = polite_schedule(spark, FOLDER)
    df.collect()
    final = plan_of(df).split("Initial Plan")[0]
    row_shuffles = [
        line for line in final.split("\n")
        if "Exchange hashpartitioning" in line and "_chunk" in line and "ReusedExchange" not in line
    ]
    # One for the rows, one for the (partially aggregated) chunk totals.
    assert len(row_shuffles) == 2 and "ReusedExchange [" in final


def test_look_up_and_listing_read_little(spark, tmp_path):
    """The id reaches both scans, and a page of results is chosen before anything wide is joined."""
    queue = spark.range(50).select(
        F.col("id").cast("string").alias("crawl_id"), F.lit("u").alias("url"), F.lit("failed").alias("status"),
        F.lit(None).cast("string").alias("error_message"), F.lit(0).alias("retry_count"),
        F.timestamp_seconds("id").alias("created_at"), F.lit(None).cast("timestamp").alias("completed_at"),
    )
    stored = spark.range(30).select(
        F.col("id").cast("string").alias("crawl_id"), F.lit("m").alias("url"), F.lit("t").alias("title"),
        F.timestamp_seconds("id").alias("created_at"), F.timestamp_seconds("id").alias("updated_at"),
    )
    queue.write.parquet(f"{tmp_path}/queue")
    stored.write.parquet(f"{tmp_path}/stored")
    queue, stored = spark.read.parquet(f"{tmp_path}/queue"), spark.read.parquet(f"{tmp_path}/stored")

    one = plan_of(results.by_id(queue, stored, "3"))
    assert one.count("EqualTo(crawl_id,3)") >= 2
    page = plan_of(results.listing(queue, stored, limit=5))
    assert "TakeOrderedAndProject" in page and page.count("LeftSemi") == 2 and "FullOuter" in page
    narrow = [line for line in page.splitlines() if "FileScan" in line and "title" not in line and "retry_count" not in line]
    assert len(narrow) >= 2  # ids and times of both sides


def test_written_rows_leave_no_shuffle_files(spark):
    from pagemill.plans import scratch

    def held():
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()

    before, setting = held(), spark.conf.get(scratch.CLEANUP)
    rows = scratch.written(spark.range(1000).repartition(4, "id"), "t-written")
    for _ in range(50):
        if held() <= before:
            break
        time.sleep(0.1)
    assert held() <= before
    assert rows.count() == 1000 and spark.conf.get(scratch.CLEANUP) == setting
