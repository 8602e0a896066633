from __future__ import annotations

from itertools import product
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from pagemill.functions import urls as U

BASES = ["http://h.example", "http://h.example/", "https://h.example/a/b/c", "https://h.example/a/b/?q=1#f",
         "http://h.example:81/x?y=/z/w"]
REFS = ["", "a", "./a", "../a", "../../a", "/a", "/a/../b", "//o.example/p", "?q=2", "#top", "a/./b/../c",
        "http://o.example/x", "mailto:a@b", "a?x=../y#../z", "..", ".", "/.", "b/.."]


def test_resolve_agrees_with_the_standard_library(spark):
    pairs = list(product(BASES, REFS))
    rows = spark.createDataFrame(pairs, "base string, ref string")
    found = rows.select("base", "ref", U.resolve(F.col("base"), F.col("ref")).alias("url")).collect()
    wrong = [(r.base, r.ref, r.url, urljoin(r.base, r.ref)) for r in found if r.url != urljoin(r.base, r.ref)]
    assert not wrong


@pytest.mark.parametrize(
    "url, host, netloc, stripped, target",
    [
        ("http://User:p@Ex.COM:8080/a?b", "ex.com", "User:p@Ex.COM:8080", "User:p@Ex.COM:8080", "/a?b"),
        ("http://e.com?q=1", "e.com", "e.com", "e.com?q=1", "/?q=1"),
        ("no scheme", None, "", "no scheme", "/no scheme"),
        ("ftp://x.org", "x.org", "x.org", "ftp:", "/"),
        ("http://[::1]:80/x", "[::1]", "[::1]:80", "[::1]:80", "/x"),
    ],
)
def test_parts(spark, url, host, netloc, stripped, target):
    u = F.lit(url)
    row = spark.range(1).select(U.host(u), U.netloc(u), U.stripped_domain(u), U.request_target(u)).first()
    assert tuple(row) == (host, netloc, stripped, target)


def test_http_check(spark):
    cases = {"http://a.b": True, "https://u:p@a.b:1/x": True, "ftp://a.b": False, "http://": False,
             "http:///x": False, "mailto:a@b": False, "http://a b/": False, "http://a.b/" + "x" * 2100: True, None: False,
             "http://[::1]:80/x": True, "https://[2001:db8::1]": True, "http://[]/": False}
    rows = spark.createDataFrame([(k,) for k in cases], "url string")
    found = {r.url: r.ok for r in rows.select("url", U.is_http(F.col("url")).alias("ok")).collect()}
    assert found == cases
