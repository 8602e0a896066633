from __future__ import annotations

import datetime as dt
import html as html_lib
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from pagemill.functions import markup as M
from pagemill.functions import text as X
from pagemill.operators import extract as E
from pagemill.schemas import SHORT_LIMITS


def fields_of(spark, page, *fields, url="http://h.example/dir/page?x=1", **options):
    rows = spark.createDataFrame([(url, page)], "url string, html string")
    row = E.extract(rows, *fields, **options).select(*fields).first()
    return row[0] if len(fields) == 1 else row


@pytest.mark.parametrize(
    "page, expected",
    [
        ("<title></title><h1> A  <!-- c --> B </h1>", "AB"),
        ("<title>a\n  b</title>", "a b"),
        ("<title> </title><h1>Head <b>line</b></h1>", "Headline"),
        ("<meta property='og:title' content='Shared &amp; kept'>", "Shared & kept"),
        ("<meta name=twitter:title content=bare><p>x", "bare"),
        ("<div itemprop=name>In <span>text</span></div>", "Intext"),
        ("<TITLE>" + "x" * 600 + "</TITLE>", "x" * 600),
        ("<p>nothing", None),
    ],
)
def test_title(spark, page, expected):
    assert fields_of(spark, page, "title") == expected


@pytest.mark.parametrize(
    "page, expected",
    [
        ('<meta content="first" name="description">', "first"),
        ('<meta name="description" content=""><meta property="og:description" content="second">', "second"),
        # A blank first match falls to the next selector, not to the next element.
        ('<meta name="description" content=" "><meta name="description" content="later"><p>para</p>', "para"),
        ('<meta name="description" content="a > b &quot;c&quot;">', 'a > b "c"'),
        ("<p>one <b>two<p>three", "onetwo"),
        ("<p data-x='1'>only</p>", "only"),
        ("<pre>no</pre>", None),
        ('<meta name="description" content="' + "y" * 1200 + '">', "y" * 1200),
        ('<meta data-name="description" content="no"><p>yes</p>', "yes"),
        ("<!-- <meta name=description content=no> --><script>var s='<p>no</p>'</script><p>yes</p>", "yes"),
    ],
)
def test_description(spark, page, expected):
    assert fields_of(spark, page, "description") == expected


def test_keywords(spark):
    page = (
        '<meta name="keywords" content="a, b;c,,a "><meta property="article:tag" content="d">'
        '<a rel="tag" href="/x"> e <i>f</i></a><a rel="tag nofollow" href="/y">no</a>'
    )
    assert fields_of(spark, page, "keywords") == ["a", "b", "c", "d", "ef"]
    many = ",".join(f"k{i}" for i in range(25))
    assert fields_of(spark, f'<meta name=keywords content="{many}">', "keywords") == [f"k{i}" for i in range(25)]
    equal = '<a rel="tag">one</a><a rel="tag">two</a><a rel="tag" href="/t">x</a><a rel="tag" href="/t">y</a>'
    assert fields_of(spark, equal, "keywords") == ["one", "two", "x", "y"]
    odd = "<i rel='tag' t='\\E'>p</i><i rel='tag' t='\\E'>q</i>"
    assert fields_of(spark, odd, "keywords") == ["p", "q"]
    assert fields_of(spark, "<p>x", "keywords") == []


@pytest.mark.parametrize(
    "page, expected",
    [
        ('<meta name="author" content="A"><meta property="article:author" content="B">', "A"),
        ('<a rel="author" href="/a"> Jane <b>Doe</b></a>', "JaneDoe"),
        ('<span itemprop="author"><span>x</span> y</span> z', "xy"),
        ('<meta name="author" content="' + "n" * 300 + '">', "n" * 300),
    ],
)
def test_author(spark, page, expected):
    assert fields_of(spark, page, "author") == expected


@pytest.mark.parametrize(
    "page, expected",
    [
        ('<meta property="article:published_time" content="2024-02-03T04:05:06Z">', dt.datetime(2024, 2, 3, 4, 5, 6)),
        ('<meta property="article:published_time" content="soon"><meta name=date content="March 5, 2023">', dt.datetime(2023, 3, 5)),
        ('<time datetime="2022-12-31">x</time>', dt.datetime(2022, 12, 31)),
        ('<meta name="date" content="Mon, 15 Jan 2024 10:30:00 GMT">', dt.datetime(2024, 1, 15, 10, 30)),
        ('<span itemprop="datePublished">15 Jan 2024</span>', dt.datetime(2024, 1, 15)),
        ('<meta name="date" content="nonsense">', None),
    ],
)
def test_published_date(spark, page, expected):
    rows = spark.createDataFrame([("http://h/", page)], "url string, html string")
    found = E.extract(rows, "published_date").select(F.unix_micros("published_date")).first()[0]
    wanted = None if expected is None else int(expected.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    assert found == wanted


@pytest.mark.parametrize(
    "page, expected",
    [
        ('<link rel="alternate canonical" href="../c">', "http://h.example/c"),
        ('<link rel="stylesheet" href="x"><meta property="og:url" content="raw value">', "raw value"),
        ('<link rel=canonical><meta property="og:url" content="u">', "u"),
        ("<p>", None),
    ],
)
def test_canonical(spark, page, expected):
    assert fields_of(spark, page, "canonical_url") == expected


def test_language(spark):
    assert fields_of(spark, "<HTML LANG='en-GB-oxendict'>", "language") == "en-GB-oxendict"
    assert fields_of(spark, '<html><meta http-equiv="content-language" content="fr">', "language") == "fr"


def test_images(spark):
    page = (
        '<head><img src="/head.png"></head>'
        '<img src="a.png" alt=" x " width=49 height=500><img src="b.png" width="50" height="50">'
        '<img src="c.png" width="49"><img src="d.png" width="0" height="10"><img src="e.png" width="50px" height="10">'
        '<img src="data:image/png;base64,AA"><img src=""><img alt="none"><IMG SRC=/f.png title="T">'
    )
    found = fields_of(spark, page, "images")
    assert [i.url.rsplit("/", 1)[1] for i in found] == ["b.png", "c.png", "d.png", "e.png", "f.png"]
    assert (found[0].width, found[0].height, found[3].width, found[4].title) == (50, 50, None, "T")
    assert len(fields_of(spark, '<img src="/i.png">' * 51, "images")) == 51


def test_links(spark):
    page = (
        '<head><a href="/head">h</a></head><a href="#x">x</a><a href="javascript:x">x</a><a href="JavaScript:x">x</a>'
        '<a href="mailto:a@b">x</a><a href="">x</a><a name="n">x</a>'
        '<a href="../a" title=" t " rel="nofollow me"> one <b>two</b> </a>'
        "<a href='?q=1&amp;r=2'>open<a href=//o.example/z></a><abbr href='/no'>n</abbr>"
    )
    found = [tuple(k) for k in fields_of(spark, page, "links")]
    assert found == [
        ("http://h.example/a", "onetwo", "t", "nofollow"),
        ("http://h.example/dir/page?q=1&r=2", "open", None, None),
        ("http://o.example/z", None, None, None),
    ]
    many = fields_of(spark, f'<a href="/n">{"t" * 250}</a>' * 101, "links")
    assert len(many) == 101 and len(many[0].text) == 250


def test_words_and_body(spark):
    page = "<head><title>no</title></head><body><ul><li>a</li><li>b</li></ul> été_1 <script>no()</script> c&nbsp;d 1 < 2"
    assert fields_of(spark, page, "word_count", "body_text") == (6, "ab été_1 c d 1 < 2")
    assert fields_of(spark, "<body><h1>a &amp</h1><p>b &lt<b>c</b>", "body_text") == "a &b <c"
    rows = spark.createDataFrame([(page,)], "html string").withColumn("url", F.lit("http://h/"))
    assert E.with_markup(rows).select(E.word_count(" ")).first()[0] == 7
    assert len(fields_of(spark, "<p>" + "word " * 3000, "body_text")) == 14999


def test_limits_cut_only_where_they_are_given(spark):
    many = ",".join(f"k{i}" for i in range(25))
    page = (
        f"<html lang=abcdefghijklmn><title>{'x' * 600}</title><meta name=description content={'d' * 1100}>"
        f"<meta name=author content={'a' * 300}><meta name=keywords content='{many}'>"
        + '<img src="/i.png">' * 51 + f'<a href="/n">{"t" * 250}</a>' * 101 + "<p>" + "word " * 3000
    )
    names = ("title", "description", "author", "language", "keywords", "images", "links", "body_text")
    short = fields_of(spark, page, *names, limits=SHORT_LIMITS)
    assert [len(v) for v in short] == [500, 1000, 200, 10, 20, 50, 100, 10000] and len(short[6][0].text) == 200
    whole = fields_of(spark, page, *names)
    assert [len(v) for v in whole][:7] == [600, 1100, 300, 14, 25, 51, 101]


def test_decoding_matches_the_standard_library(spark):
    cases = ["a &amp; b", "&lt;p&gt;", "&eacute;&#233;&#xE9;", "&#128512; &#146;", "&copy 2024", "no refs", "&&amp;;", "&nbsp;x"]
    rows = spark.createDataFrame([(c,) for c in cases], "s string")
    for r in rows.select("s", X.decode_entities(F.col("s")).alias("d")).collect():
        assert r.d == html_lib.unescape(r.s)
    odd = spark.range(1).select(X.decode_entities(F.lit("?a=1&copy=2 &unknown; &#0; &#xD800;"))).first()[0]
    assert odd == "?a=1&copy=2 &unknown; &#0; &#xD800;"


class Reader(HTMLParser):
    """Independent reading of body text and links with the standard tokenizer."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.text, self.links = 0, [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head", "title"):
            self.skip += 1
        elif tag == "a" and not self.skip and dict(attrs).get("href"):
            self.links.append(dict(attrs)["href"])

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head", "title"):
            self.skip -= 1

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def test_sample_pages_against_the_standard_tokenizer(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = E.extract(pages, "word_count", "links").select("html", "word_count", "links").collect()
    for r in rows:
        reader = Reader()
        reader.feed(r.html)
        reader.close()
        assert r.word_count == len(re.findall(r"\b\w+\b", "".join(reader.text).lower()))
        assert len(r.links) == len(reader.links)


@pytest.mark.parametrize(
    "page",
    [
        "<a " + 'x="1" ' * 20000,  # truncated inside a tag
        "<p " + "=" * 50000,
        "<" * 50000,
        "<div>" * 20000 + "deep",
        '<meta name="description" content="' + "z" * 100000,
        "<script>" + "<" * 50000,
        "<a href='x" * 3000,
        "<a " * 100000,
        "<p>x" + " " * 1000000 + "y</p>",
        "<title>" + "&nbsp; " * 50000 + "</title>",
    ],
)
def test_hostile_markup_finishes(spark, page):
    rows = spark.createDataFrame([("http://h/", page)], "url string, html string")
    assert E.extract(rows).count() == 1
    E.extract(rows).drop("html").collect()


def test_text_of_void_and_missing(spark):
    row = spark.range(1).select(
        M.text_of(F.lit("<br>x"), F.lit("<br>")), M.text_of(F.lit("<b>open x"), F.lit("<b>"))
    ).first()
    assert tuple(row) == ("", "open x")
