"""Page metadata from HTML.

Every field is a column expression over ``html`` and ``url``: no shuffle, no
Python on the executors, and a query that selects few fields pays only for
those, since the unused intermediate columns are pruned.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill import schemas as S
from pagemill.functions import markup as M
from pagemill.functions import text as X
from pagemill.functions import urls as U
from pagemill.functions.dates import lenient_date

# Where each field is looked for, in order of preference.
TITLE_ATTRS = [("property", "og:title"), ("name", "twitter:title"), ("itemprop", "name")]
DESCRIPTION_ATTRS = [
    ("name", "description"),
    ("property", "og:description"),
    ("name", "twitter:description"),
    ("itemprop", "description"),
]
KEYWORD_ATTRS = [("name", "keywords"), ("property", "article:tag"), ("rel", "tag")]
AUTHOR_ATTRS = [
    ("name", "author"),
    ("property", "article:author"),
    ("name", "twitter:creator"),
    ("itemprop", "author"),
    ("rel", "author"),
]
DATE_ATTRS = [
    ("property", "article:published_time"),
    ("name", "publication_date"),
    ("itemprop", "datePublished"),
    ("name", "date"),
]
# Written date forms read besides the ISO ones.
WEEKDAY = r"^(?i:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+"
DATE_FORMATS = (
    "MMMM d, yyyy",
    "MMM d, yyyy",
    "d MMMM yyyy",
    "d MMM yyyy",
    "M/d/yyyy",
    "yyyy/M/d",
    "d MMM yyyy HH:mm:ss z",
    "d MMM yyyy HH:mm:ss Z",
    "MMMM d, yyyy HH:mm:ss",
    "MMMM d, yyyy h:mm a",
)

_CANDIDATE = r"""(?i)[\s"'/](?:name|property|itemprop|rel|http-equiv|datetime|lang)\s*="""


def _cut(text: Column, chars: int | None) -> Column:
    return text if chars is None else F.left(text, F.lit(chars))


def _first(entries: Column, n: int | None) -> Column:
    return entries if n is None else F.slice(entries, 1, n)


def _candidates(active: Column) -> Column:
    """Start tags that carry a selecting attribute, raw and with fenced attributes."""
    tags = F.filter(M.start_tags(active), lambda t: t.rlike(_CANDIDATE))

    def numbered(found: Column) -> Column:
        # Equal tags are told apart by their number among each other.
        def entry(t: Column, i: Column) -> Column:
            nth = F.size(F.filter(F.slice(found, F.lit(1), i + 1), lambda other: other == t))
            return F.struct(t.alias("raw"), M.fenced(t).alias("tag"), nth.alias("nth"))

        return F.transform(found, entry)

    return X.let(tags, numbered)


def with_markup(pages: DataFrame) -> DataFrame:
    """Add the shared intermediate columns; unused ones are pruned by the optimizer."""
    return (
        pages.withColumn("_active", M.without_inert(F.col("html")))
        .withColumn("_inner", M.without_head(F.col("_active")))
        .withColumn("_marked", _field("_marked", pages.sparkSession.sparkContext.applicationId))
    )


def _all_with(attr: tuple[str, str]) -> Column:
    return F.filter(F.col("_marked"), lambda m: M.attr_is(m["tag"], *attr))


def _content_or_text(m: Column) -> Column:
    return F.when(M.has_attr(m["tag"], "content"), X.strip_blanks(M.attr(m["tag"], "content"))).otherwise(
        M.text_of(F.col("_active"), m["raw"], m["nth"])
    )


def _first_value(groups: list[Column], read) -> Column:
    """First non-null ``read`` over the first element of each group, in group order."""
    firsts = F.filter(F.array(*[F.get(g, F.lit(0)) for g in groups]), lambda m: m.isNotNull())
    return F.get(F.filter(F.transform(firsts, read), lambda v: v.isNotNull()), F.lit(0))


def _first_with(attrs: list[tuple[str, str]]) -> Column:
    """Value of the first element of each selector in turn; blank counts as missing."""
    return _first_value([_all_with(a) for a in attrs], lambda m: X.blank_to_null(_content_or_text(m)))


def title(limits: S.Limits = S.NO_LIMITS) -> Column:
    tags = F.array(*[F.get(M.tags_named(F.col("_active"), n), F.lit(0)) for n in ("title", "h1")])
    texts = F.transform(
        F.filter(tags, lambda t: t.isNotNull()),
        lambda t: X.blank_to_null(M.text_of(F.col("_active"), t)),
    )
    named = F.get(F.filter(texts, lambda v: v.isNotNull()), F.lit(0))
    return _cut(X.collapse_blanks(F.coalesce(named, _first_with(TITLE_ATTRS))), limits.title)


def description(limits: S.Limits = S.NO_LIMITS) -> Column:
    text = F.coalesce(
        _first_with(DESCRIPTION_ATTRS), X.blank_to_null(M.first_paragraph(F.col("_active")))
    )
    return _cut(X.collapse_blanks(text), limits.description)


def keyword_list(text: Column, separators: str = ",") -> Column:
    """Separated string to list: trimmed, blanks dropped, null gives an empty list."""
    parts = F.transform(F.split(text, f"[{separators}]", -1), X.strip_blanks)
    return F.coalesce(F.filter(parts, lambda k: k != ""), F.array().cast("array<string>"))


def keywords(limits: S.Limits = S.NO_LIMITS) -> Column:
    """All matches of every selector, distinct in order of first appearance."""

    def of(m: Column) -> Column:
        value = _content_or_text(m)
        return F.when(M.has_attr(m["tag"], "content"), keyword_list(value, ",;")).otherwise(
            F.filter(F.array(value), lambda k: k != "")
        )

    found = F.flatten(F.transform(F.concat(*[_all_with(a) for a in KEYWORD_ATTRS]), of))
    return _first(F.array_distinct(found), limits.keywords)


def author(limits: S.Limits = S.NO_LIMITS) -> Column:
    return _cut(_first_with(AUTHOR_ATTRS), limits.author)


def parse_date(text: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """Timestamp from an ISO date, a form of the list or a date in free form; null when the text names none."""

    def parse(t: Column) -> Column:
        iso = F.when(t.rlike(r"^[0-9]{4}(?:-[0-9]{1,2}){0,2}(?:$|[T ])"), t.try_cast("timestamp"))
        return F.coalesce(iso, *[F.try_to_timestamp(t, F.lit(f)) for f in formats], lenient_date(t))

    return X.let(F.regexp_replace(text, WEEKDAY, ""), parse)


def published_date() -> Column:
    """First selector whose value parses; an unparseable one falls through."""

    def value(m: Column) -> Column:
        return F.when(M.has_attr(m["tag"], "datetime") & ~M.has_attr(m["tag"], "content"),
                      X.strip_blanks(M.attr(m["tag"], "datetime"))).otherwise(_content_or_text(m))

    clocks = F.filter(
        F.col("_marked"),
        lambda m: (M.tag_name(m["raw"]) == "time") & M.has_attr(m["tag"], "datetime"),
    )
    return _first_value(
        [_all_with(a) for a in DATE_ATTRS] + [clocks], lambda m: parse_date(value(m))
    )


def canonical_url() -> Column:
    link = F.get(
        F.filter(
            F.col("_marked"),
            lambda m: (M.tag_name(m["raw"]) == "link")
            & F.array_contains(F.split(M.attr(m["tag"], "rel"), r"\s+"), "canonical"),
        ),
        F.lit(0),
    )
    shared = F.get(
        F.filter(
            F.col("_marked"),
            lambda m: (M.tag_name(m["raw"]) == "meta") & M.attr_is(m["tag"], "property", "og:url"),
        ),
        F.lit(0),
    )
    return F.coalesce(
        F.when(
            link.isNotNull() & M.has_attr(link["tag"], "href"),
            U.resolve(F.col("url"), X.strip_blanks(M.attr(link["tag"], "href"))),
        ),
        F.when(shared.isNotNull() & M.has_attr(shared["tag"], "content"), M.attr(shared["tag"], "content")),
    )


def language(limits: S.Limits = S.NO_LIMITS) -> Column:
    root = F.get(F.filter(F.col("_marked"), lambda m: M.tag_name(m["raw"]) == "html"), F.lit(0))
    declared = F.get(
        F.filter(
            F.col("_marked"),
            lambda m: (M.tag_name(m["raw"]) == "meta")
            & M.attr_is(m["tag"], "http-equiv", "content-language"),
        ),
        F.lit(0),
    )
    return F.coalesce(
        F.when(root.isNotNull() & M.has_attr(root["tag"], "lang"), _cut(M.attr(root["tag"], "lang"), limits.language)),
        F.when(
            declared.isNotNull() & M.has_attr(declared["tag"], "content"),
            _cut(M.attr(declared["tag"], "content"), limits.language),
        ),
    )


def word_count(separator: str = "") -> Column:
    return X.count_words(F.lower(M.plain_text(F.col("_inner"), separator)))


def body_text(limits: S.Limits = S.NO_LIMITS, separator: str = "") -> Column:
    return _cut(X.strip_blanks(X.collapse_blanks(M.plain_text(F.col("_inner"), separator))), limits.body)


def int_attr(tag: Column, name: str) -> Column:
    """Whole-number attribute; anything else (``50px``) is null."""
    return X.let(
        X.strip_blanks(M.attr(tag, name)),
        lambda v: F.when(v.rlike(r"^[+-]?[0-9]+$"), v.try_cast("int")),
    )


def images(limits: S.Limits = S.NO_LIMITS) -> Column:
    def raw(tag: Column) -> Column:
        return F.struct(
            X.strip_blanks(M.attr(tag, "src")).alias("src"),
            M.attr_or_null(tag, "alt").alias("alt_text"),
            M.attr_or_null(tag, "title").alias("title"),
            int_attr(tag, "width").alias("width"),
            int_attr(tag, "height").alias("height"),
        )

    def placed(i: Column) -> Column:
        rest = [i[n].alias(n) for n in ("alt_text", "title", "width", "height")]
        return F.struct(U.resolve(F.col("url"), i["src"]).alias("url"), *rest)

    def wanted(i: Column) -> Column:
        sized = (F.coalesce(i["width"], F.lit(0)) != 0) & (F.coalesce(i["height"], F.lit(0)) != 0)
        return ~(sized & (F.least(i["width"], i["height"]) < S.MIN_IMAGE_SIDE)) & (i["src"] != "")

    tags = F.transform(M.tags_named(F.col("_inner"), "img"), M.fenced)
    found = F.transform(F.filter(F.transform(tags, raw), wanted), placed)
    return _first(F.filter(found, lambda i: U.is_http(i["url"])), limits.images)


def links(limits: S.Limits = S.NO_LIMITS) -> Column:
    # Each piece starts inside an <a ...> tag and ends before the next one, where an open link ends.
    pieces = F.split(F.col("_inner"), r"(?i)<a(?=\s)", -1)
    anchors = F.filter(pieces, lambda p, i: i > 0)

    def split_tag(p: Column) -> Column:
        return X.let(
            F.regexp_extract(p, rf"^({M.ATTRS})>", 1),
            lambda head: F.struct(
                M.fenced(head).alias("tag"),
                F.substring(p, F.length(head) + 2, F.length(p)).alias("rest"),
            ),
        )

    def raw(p: Column) -> Column:
        inner = F.regexp_extract(p["rest"], r"(?i)^([\s\S]*?)(?:</a\s*>|\z)", 1)
        return F.struct(
            M.attr(p["tag"], "href").alias("href"),
            X.blank_to_null(_cut(M.trimmed_text(inner), limits.link_text)).alias("text"),
            M.attr_or_null(p["tag"], "title").alias("title"),
            X.blank_to_null(F.regexp_extract(M.attr(p["tag"], "rel"), r"(\S+)", 1)).alias("rel"),
        )

    def wanted(k: Column) -> Column:
        return ~(
            (k["href"] == "")
            | F.startswith(k["href"], F.lit("#"))
            | F.startswith(k["href"], F.lit("javascript:"))
        )

    def placed(k: Column) -> Column:
        target = U.resolve(F.col("url"), X.strip_blanks(k["href"]))
        return F.struct(target.alias("url"), *[k[n].alias(n) for n in ("text", "title", "rel")])

    found = F.transform(F.filter(F.transform(F.transform(anchors, split_tag), raw), wanted), placed)
    return _first(F.filter(found, lambda k: U.is_http(k["url"])), limits.links)


def content_hash() -> Column:
    return F.sha2(F.col("html").cast("binary"), 256)


FIELDS = {
    "_marked": lambda _: _candidates(F.col("_active")),
    "domain": lambda _: U.host(F.col("url")),
    "title": title,
    "description": description,
    "keywords": keywords,
    "author": author,
    "published_date": lambda _: published_date(),
    "canonical_url": lambda _: canonical_url(),
    "language": language,
    "content_type": lambda _: F.lit("text/html"),
    "word_count": lambda _: word_count(),
    "images": images,
    "links": links,
    "content_hash": lambda _: content_hash(),
    "body_text": body_text,
}


@lru_cache(maxsize=256)
def _field(name: str, session: str, limits: S.Limits = S.NO_LIMITS) -> Column:
    """Field expressions name columns, not tables, so one serves every plan of a session."""
    return FIELDS[name](limits)


def extract(pages: DataFrame, *fields: str, limits: S.Limits = S.NO_LIMITS) -> DataFrame:
    """Add the named metadata fields (all of them by default) to a table with ``url`` and ``html``, whole unless ``limits`` cut them."""
    wanted = fields or tuple(n for n in FIELDS if n != "_marked")
    session = pages.sparkSession.sparkContext.applicationId
    return (
        with_markup(pages)
        .withColumns({name: _field(name, session, limits) for name in wanted})
        .drop("_active", "_inner", "_marked")
    )


def page_summary(metadata: DataFrame, *keep: str) -> DataFrame:
    """List sizes and the three strongest topics of each page."""
    return metadata.select(
        *keep,
        F.size("keywords").alias("n_keywords"),
        F.size("images").alias("n_images"),
        F.size("links").alias("n_links"),
        F.size("topics").alias("n_topics"),
        F.transform(F.slice("topics", 1, 3), lambda t: t["topic"]).alias("top_topics"),
    )
