from __future__ import annotations

from itertools import product
from urllib.robotparser import RobotFileParser

from pyspark.sql import functions as F

from pagemill.operators import robots as R

FILES = [
    "User-agent: *\nDisallow: /private\nAllow: /private/ok",
    "User-agent: *\nAllow: /private/ok\nDisallow: /private",
    "User-agent: lens\nDisallow: /\n\nUser-agent: *\nDisallow:",
    "user-AGENT: lens\nUser-agent: other\nCrawl-delay: 7\nDisallow: /a # note\n\nUser-agent: *\nDisallow: /b\nCrawl-delay: 2",
    "Disallow: /orphan\nUser-agent: *\n\nDisallow: /lost\nUser-agent: *\nDisallow: /x",
    "# only\n\nSitemap: http://s.example/a:b.xml\nUser-agent: *\nDisallow: /q?\nSitemap: http://s.example/2.xml",
    "User-agent: *\r\nDisallow: /cr\r\nUser-agent: lens\r\nDisallow: /lens\r\n",
    "User-agent: *\nDisallow: /first\n\nUser-agent: *\nDisallow: /second",
    "User-agent: lens\nUser-agent: *\nDisallow: /both\nCrawl-delay: x",
    "User-agent: *\nUnknown: /z\nDisallow: /k\nRequest-rate: 1/5",
    "User-agent: *\nDisallow: /a b\nDisallow: /~u\nDisallow: /é\nDisallow: /p%2fq\nDisallow: /c+d\nDisallow: /100%\nAllow: /r",
    "", "garbage without colon\n:\n: /x",
]
AGENTS = ["Lens/2.0 (+x)", "other", "Nobody", ""]
PATHS = ["/", "/private", "/private/ok/1", "/a", "/b/c", "/orphan", "/lost", "/x", "/q?z=1", "/cr", "/lens", "/first", "/second", "/both", "/k", "",
         "/a%20b", "/a b", "/%7Eu", "/~u/x", "/%C3%A9", "/é", "/p/q", "/p%2Fq", "/c+d", "/c%2Bd", "/c d", "/100%", "/100%25", "/%72"]


def readers():
    for text in FILES:
        reader = RobotFileParser()
        reader.parse(text.replace("\r\n", "\n").split("\n"))
        yield reader


def test_against_the_standard_reader(spark):
    snaps = spark.createDataFrame(list(enumerate(FILES)), "file int, content string")
    asks = [
        (i, f, agent, f"http://h.example{path}")
        for i, (f, agent, path) in enumerate(product(range(len(FILES)), AGENTS, PATHS))
    ]
    requests = spark.createDataFrame(asks, "id int, file int, user_agent string, url string").withColumn(
        "respect_robots_txt", F.lit(True)
    )
    checked = R.check_requests(requests, R.robots_files(snaps, "file"), ["file"], "id")
    known = list(readers())
    wrong = []
    for r in checked.collect():
        reader = known[r.file]
        delay = reader.crawl_delay(r.user_agent)
        expected = (
            reader.can_fetch(r.user_agent, r.url), float(delay) if delay else None, reader.site_maps() or []
        )
        if (r.allowed, r.robots_delay, list(r.sitemaps)) != expected:
            wrong.append((r, expected))
    assert not wrong


def test_switches_and_missing_files(spark):
    files = R.robots_files(spark.createDataFrame([("d", "User-agent: *\nDisallow: /")], "domain string, content string"), "domain")
    requests = spark.createDataFrame(
        [(1, "d", True), (2, "d", False), (3, "other", True), (4, None, True), (5, "d", None)],
        "id int, domain string, respect_robots_txt boolean",
    ).withColumn("url", F.lit("http://d/x")).withColumn("user_agent", F.lit(None).cast("string"))

    def verdicts(**options):
        return {r.id: r.allowed for r in R.check_requests(requests, files, ["domain"], "id", **options).collect()}

    assert verdicts() == {1: False, 2: True, 3: True, 4: True, 5: False}  # unset means respected
    assert set(verdicts(respect=False).values()) == {True}


def test_latest_copy_that_failed_has_no_rules(spark):
    rows = [("a", 1, 200, "User-agent: *"), ("a", 2, 404, "gone"), ("b", 1, 404, None), ("b", 5, 200, "text")]
    snaps = spark.createDataFrame(rows, "domain string, fetched_at int, http_status int, content string")
    assert {r.domain: r.content for r in R.latest_snapshots(snaps).collect()} == {"a": None, "b": "text"}


def test_copies_of_one_fetch_do_not_mix(spark):
    text = "User-agent: *\nDisallow: /a\n\nUser-agent: lens\nDisallow: /b"
    rows = spark.createDataFrame([("d", 1, 200, text)] * 50 + [("d", 2, 404, "x")], "domain string, fetched_us long, http_status int, content string")
    files = R.robots_files(R.single_copies(rows, ["domain"]), "domain").first()
    assert [list(g.agents) for g in files.groups] == [["*"], ["lens"]] and len(files.groups[0].rules) == 1
