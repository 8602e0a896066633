"""End-to-end plans: responses to stored metadata, requests to a crawl plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill import schemas as S
from pagemill.functions import urls as U
from pagemill.operators import extract as E
from pagemill.operators import topics as T
from pagemill.operators.gates import BLOCKED_MESSAGE, accepted, gate_responses
from pagemill.operators.requests import validate_requests
from pagemill.operators.robots import check_requests, fresh_snapshot, robots_files, single_copies
from pagemill.operators.schedule import polite_schedule
from pagemill.plans.scratch import durable


def with_topics(pages: DataFrame, topics: T.Dictionary = T.TOPIC_KEYWORDS, **options) -> DataFrame:
    """Add ``topics`` from title, description, keywords and body text."""
    text = T.classification_text(
        F.col("title"), F.col("description"), F.col("keywords"), F.col("body_text")
    )
    return pages.withColumn("topics", T.topics_of(text, topics, **options))


def page_metadata(
    responses: DataFrame,
    topics: T.Dictionary = T.TOPIC_KEYWORDS,
    max_bytes: int | None = None,
    limits: S.Limits = S.NO_LIMITS,
) -> DataFrame:
    """Accepted responses to metadata records. One narrow stage: no shuffle, the HTML ends here."""
    pages = E.extract(accepted(gate_responses(responses, max_bytes)), limits=limits)
    return with_topics(pages, topics).select(
        *[
            F.col("response_headers").alias("headers") if name == "headers"
            else F.col("fetched_at").alias(name) if name in ("crawl_timestamp", "created_at", "updated_at")
            else F.col(name)
            for name in S.PAGE_METADATA.names
        ]
    )


def history_of(responses: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """One history row per response; its domain keeps port and case."""
    return gate_responses(responses, max_bytes).select(
        "crawl_id",
        "url",
        U.netloc(F.col("url")).alias("domain"),
        "status",
        "status_code",
        "response_time_ms",
        "error_message",
        F.col("fetched_at").alias("crawl_timestamp"),
    )


def with_verdict(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Add ``allowed``, ``robots_delay``, ``sitemaps`` and ``snapshot_us``: the rules of the copy still valid at each request's time."""
    # Narrow and read three times below: written once rather than derived again.
    fresh = durable(fresh_snapshot(requests.select("request_id", "domain", "arrival_us"), snapshots))
    # Only copies that some request falls on are parsed.
    wanted = fresh.filter(F.col("snapshot_us").isNotNull()).select("domain", "snapshot_us").distinct()
    copies = single_copies(
        snapshots.withColumnRenamed("fetched_us", "snapshot_us"), ["domain", "snapshot_us"]
    ).join(wanted, ["domain", "snapshot_us"], "left_semi")
    files = robots_files(
        copies.select(F.struct("domain", "snapshot_us").alias("_file"), "content"), "_file"
    ).select("_file.domain", "_file.snapshot_us", "groups", "sitemaps")
    dated = requests.join(fresh.select("request_id", "snapshot_us"), "request_id")
    return check_requests(dated, files, ["domain", "snapshot_us"], "request_id", counted=fresh)


def crawl_plan(requests: DataFrame, snapshots: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """Valid requests with robots verdict and start time.

    ``requests`` carries ``request_id``, ``url``, ``arrival_us`` and the optional
    request settings; ``snapshots`` carries ``domain``, ``fetched_us``, ``http_status``
    and ``content``. Blocked requests keep a row with their message and no start.
    Verdicts are written once, narrow; the schedule and the plan both read them.
    """
    valid = (
        validate_requests(requests)
        .filter(F.size("errors") == 0)
        .drop("errors")
        .withColumn("domain", U.netloc_key(F.col("url")))
    )
    added = ["snapshot_us", "allowed", "robots_delay", "sitemaps"]
    verdict = durable(
        with_verdict(valid, snapshots).select("request_id", "domain", "arrival_us", "crawl_delay", *added)
    )
    timed = polite_schedule(verdict.filter("allowed"), settings)
    # Request ids are unique, so these joins have no hot key.
    return (
        valid.join(verdict.select("request_id", *added), "request_id")
        .join(timed.select("request_id", "request_number", "start_us", "wait_us"), "request_id", "left")
        .withColumn("error_message", F.when(~F.col("allowed"), BLOCKED_MESSAGE))
    )
