"""Time the headline queries and print one JSON line.

Each query is run once to warm the JVM and once for the record. Results are
fully computed and dropped, so no driver transfer is in the figures; building
the plan is.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pagemill import catalog
from pagemill.session import build_session

HEADLINE = (
    "domain_words", "page_core", "page_meta_fields", "page_links", "page_images", "fetch_gates", "body_text",
    "topic_scores", "topic_scores_sample", "page_topics", "url_topics", "topics_enhanced",
    "polite_schedule", "domain_stats", "robots_allow", "robots_fresh", "crawl_plan",
    "status_current", "result_view", "result_list", "batch_totals", "queue_next_per_domain",
    "hist_duration", "corpus_summary", "dup_content", "fulltext_any", "trigram_titles",
    "store_serves", "history_purge", "stream_extract", "stream_status", "stream_dedup", "stream_robots",
)
#: Queries whose rate is told in MB of HTML per second and core.
RATES = ("page_core", "page_topics")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        app="bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = catalog.queries()
    times: dict[str, float] = {}
    for name in HEADLINE:
        for _ in range(2):
            begin = time.perf_counter()
            found[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - begin, 3)
    megabytes = spark.read.parquet(f"{folder}/pages.parquet").selectExpr("sum(octet_length(html)) / 1e6").first()[0]
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "mb_per_second_and_core": {n: round(megabytes / times[n] / int(cpus), 3) for n in RATES},
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
