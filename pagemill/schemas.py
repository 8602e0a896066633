"""Table schemas, limits and fixed values of the data model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Size gates, string caps, list caps, thresholds and lifetimes. Size, string and list caps are
# never applied by themselves; a caller who wants them passes them.
MAX_CONTENT_BYTES = 10 * 1024 * 1024
TITLE_CHARS = 500
DESCRIPTION_CHARS = 1000
AUTHOR_CHARS = 200
LANGUAGE_CHARS = 10
LINK_TEXT_CHARS = 200
BODY_CHARS = 10000
MAX_KEYWORDS = 20
MAX_IMAGES = 50
MAX_LINKS = 100
MAX_TOPICS = 10
TOPIC_KEYWORDS = 5
MIN_TOPIC_CONFIDENCE = 0.5
MIN_IMAGE_SIDE = 50
URL_TOPIC_CONFIDENCE = 0.7
URL_TOPIC_BOOST = 0.2
DEFAULT_CRAWL_DELAY = 1.0
DEFAULT_RETRIES = 3
DEFAULT_PRIORITY = 5
PRIORITIES = (1, 5, 10)
RETRY_RANGE = (0, 10)
DELAY_RANGE = (0.1, 60.0)
BATCH_RANGE = (1, 1000)
ROBOTS_TTL_SECONDS = 86400
RESULT_TTL_SECONDS = 3600
LIMITER_TTL_SECONDS = 3600
HISTORY_DAYS = 30
METRIC_WINDOW = "15 seconds"
STATUSES = ("pending", "processing", "completed", "failed", "retry")
SETTLED = ("completed", "failed")


@dataclass(frozen=True)
class Limits:
    """Cuts of extracted values, in characters or entries. None keeps everything."""

    title: int | None = None
    description: int | None = None
    author: int | None = None
    language: int | None = None
    link_text: int | None = None
    body: int | None = None
    keywords: int | None = None
    images: int | None = None
    links: int | None = None


NO_LIMITS = Limits()
SHORT_LIMITS = Limits(
    TITLE_CHARS, DESCRIPTION_CHARS, AUTHOR_CHARS, LANGUAGE_CHARS, LINK_TEXT_CHARS, BODY_CHARS,
    MAX_KEYWORDS, MAX_IMAGES, MAX_LINKS,
)

IMAGE = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("alt_text", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
])

LINK = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("rel", T.StringType()),
])

TOPIC = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("keywords", T.ArrayType(T.StringType())),
])

_HEADERS = T.MapType(T.StringType(), T.StringType())

PAGE_METADATA = T.StructType([
    T.StructField("crawl_id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("keywords", T.ArrayType(T.StringType())),
    T.StructField("author", T.StringType()),
    T.StructField("published_date", T.TimestampType()),
    T.StructField("canonical_url", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("word_count", T.IntegerType()),
    T.StructField("images", T.ArrayType(IMAGE)),
    T.StructField("links", T.ArrayType(LINK)),
    T.StructField("topics", T.ArrayType(TOPIC)),
    T.StructField("headers", _HEADERS),
    T.StructField("content_hash", T.StringType()),
    T.StructField("response_time_ms", T.IntegerType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("crawl_timestamp", T.TimestampType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

CRAWL_REQUEST = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("priority", T.IntegerType()),
    T.StructField("max_retries", T.IntegerType()),
    T.StructField("crawl_delay", T.DoubleType()),
    T.StructField("respect_robots_txt", T.BooleanType()),
    T.StructField("user_agent", T.StringType()),
    T.StructField("headers", _HEADERS),
])

BATCH_REQUEST = T.StructType(
    [T.StructField("urls", T.ArrayType(T.StringType()))] + CRAWL_REQUEST.fields[1:]
)

CRAWL_QUEUE = T.StructType([
    T.StructField("crawl_id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("priority", T.IntegerType()),
    T.StructField("retry_count", T.IntegerType()),
    T.StructField("max_retries", T.IntegerType()),
    T.StructField("crawl_delay", T.DecimalType(5, 2)),
    T.StructField("respect_robots_txt", T.BooleanType()),
    T.StructField("user_agent", T.StringType()),
    T.StructField("headers", _HEADERS),
    T.StructField("scheduled_at", T.TimestampType()),
    T.StructField("processing_started_at", T.TimestampType()),
    T.StructField("completed_at", T.TimestampType()),
    T.StructField("status", T.StringType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

CRAWL_HISTORY = T.StructType([
    T.StructField("crawl_id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("response_time_ms", T.IntegerType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("crawl_timestamp", T.TimestampType()),
])

ROBOTS_SNAPSHOT = T.StructType([
    T.StructField("domain", T.StringType()),
    T.StructField("fetched_at", T.TimestampType()),
    T.StructField("http_status", T.IntegerType()),
    T.StructField("content", T.StringType()),
])

RESPONSE = T.StructType([
    T.StructField("crawl_id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("response_headers", _HEADERS),
    T.StructField("response_time_ms", T.IntegerType()),
    T.StructField("fetched_at", T.TimestampType()),
    T.StructField("failure", T.StringType()),
    T.StructField("failure_message", T.StringType()),
])
