"""Response gates: which fetched responses become pages, and why the others do not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Messages of refused requests.
BLOCKED_MESSAGE = "Blocked by robots.txt"
FAILED_MESSAGE = "Failed to crawl URL"
TIMEOUT_MESSAGE = "Request timeout"
# How a fetch fails that brings no response; history keeps these for good.
FAILURES = ("timeout", "error")


def header(headers: Column, name: str) -> Column:
    """Header value, name matched without case; empty when absent."""
    found = F.map_filter(headers, lambda k, _: F.lower(k) == name)
    return F.coalesce(F.get(F.map_values(found), F.lit(0)), F.lit(""))


def reject_reason(
    status_code: Column, content_type: Column, html: Column, max_bytes: int | None = None
) -> Column:
    """Null for an acceptable response; the first failing gate otherwise."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    reason = F.when(status_code.isNull() | (status_code != 200), F.lit("status")).when(
        ~F.startswith(kind, F.lit("text/html")), F.lit("content_type")
    )
    return reason if max_bytes is None else reason.when(F.octet_length(html) > max_bytes, F.lit("size"))


def gate_responses(responses: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Tag every response with ``reject_reason``, the resulting status and its message.

    A fetch that brought no response says so in an optional ``failure`` column, with
    its own words in ``failure_message``; it keeps that name as reason and status.
    """
    reason = reject_reason(
        F.col("status_code"), header(F.col("response_headers"), "content-type"), F.col("html"), max_bytes
    )
    none = F.lit(None).cast("string")
    failure = F.col("failure") if "failure" in responses.columns else none
    words = F.col("failure_message") if "failure_message" in responses.columns else none
    failed = F.when(failure.isin(*FAILURES), failure)
    own = F.coalesce(words, F.when(failed == "timeout", TIMEOUT_MESSAGE), F.lit(FAILED_MESSAGE))
    return responses.withColumns({
        "reject_reason": F.coalesce(failed, reason),
        "status": F.coalesce(failed, F.when(reason.isNull(), "completed").otherwise("failed")),
        "error_message": F.when(failed.isNotNull(), own).when(reason.isNotNull(), FAILED_MESSAGE),
    })


def accepted(gated: DataFrame) -> DataFrame:
    return gated.filter(F.col("reject_reason").isNull()).drop("reject_reason", "error_message")


def request_headers(headers: Column, user_agent: Column) -> Column:
    """Request headers with ``user_agent``, when given, in place of any ``User-Agent`` entry."""
    base = F.coalesce(headers, F.create_map().cast("map<string,string>"))
    others = F.map_filter(base, lambda k, _: k != "User-Agent")
    return F.when(
        F.coalesce(user_agent, F.lit("")) != "",
        F.map_concat(others, F.create_map(F.lit("User-Agent"), user_agent)),
    ).otherwise(base)
