"""Robots files: parsing to rules, permission, delay, sitemaps, freshness.

Rule semantics are those of the usual reader: the first named group whose agent
name occurs in the asking agent, else the first ``*`` group; within it the first
rule in file order whose path is a prefix of the target; no match allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.functions import urls as U
from pagemill.plans.ordered import running_max
from pagemill.plans.skew import spread_join
from pagemill.schemas import ROBOTS_TTL_SECONDS

RULES = ("disallow", "allow", "crawl-delay", "request-rate")


def robots_lines(snapshots: DataFrame, key: str) -> DataFrame:
    """One row per meaningful line: ``(key, line, kind, value)``; ``kind`` is ``blank`` for an empty line."""
    raw = snapshots.select(key, F.posexplode(F.split("content", "\n", -1)).alias("line", "raw"))
    bare = X.strip_blanks(F.regexp_replace("raw", "#.*$", ""))
    return (
        raw.withColumn("text", bare)
        .filter((F.col("text") != "") | (X.strip_blanks(F.col("raw")) == ""))
        .select(
            key,
            "line",
            F.when(F.col("text") == "", "blank")
            .otherwise(F.lower(F.regexp_extract("text", r"^([^:\s]+)\s*:", 1)))
            .alias("kind"),
            X.strip_blanks(F.regexp_extract("text", r"^[^:]*:([\s\S]*)$", 1)).alias("value"),
        )
        .filter(F.col("kind").isin("blank", "user-agent", "sitemap", *RULES))
    )


def robots_rules(snapshots: DataFrame, key: str) -> DataFrame:
    """Rule rows ``(key, line, group_id, kind, value)``; ``group_id`` is null outside any group.

    Windows run over one file at a time.
    """
    lines = robots_lines(snapshots, key)
    # Sitemap lines stand outside the group structure.
    shape = F.col("kind") != "sitemap"
    order = Window.partitionBy(key).orderBy("line")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    marked = lines.withColumn(
        "_previous", F.last(F.when(shape, F.col("kind")), ignorenulls=True).over(before)
    ).withColumn(
        "_opens",
        (F.col("kind") == "user-agent") & (F.coalesce("_previous", F.lit("")) != "user-agent"),
    )
    grouped = (
        marked.withColumn("_group", F.sum(F.col("_opens").cast("int")).over(so_far))
        .withColumn("_agent", F.max(F.when(F.col("kind") == "user-agent", F.col("line"))).over(so_far))
        .withColumn("_blank", F.max(F.when(F.col("kind") == "blank", F.col("line"))).over(so_far))
    )
    inside = F.col("_agent") > F.coalesce("_blank", F.lit(-1))
    return grouped.filter(F.col("kind") != "blank").select(
        key,
        "line",
        F.when((F.col("kind") != "sitemap") & inside, F.col("_group")).alias("group_id"),
        "kind",
        "value",
    )


def robots_files(snapshots: DataFrame, key: str) -> DataFrame:
    """One row per file: ``groups`` (agents, rules, delay, in file order) and ``sitemaps``.

    A group without any rule line is no group.
    """
    rules = robots_rules(snapshots, key)
    is_rule = F.col("kind").isin("allow", "disallow")

    def ordered(wanted: Column, *cells: Column) -> Column:
        packed = F.collect_list(F.when(wanted, F.struct("line", *cells)))
        return F.array_sort(packed)

    groups = (
        rules.filter(F.col("group_id").isNotNull())
        .groupBy(key, "group_id")
        .agg(
            ordered(F.col("kind") == "user-agent", F.lower("value").alias("agent")).alias("agents"),
            ordered(
                is_rule,
                ((F.col("kind") == "allow") | (F.col("value") == "")).alias("allow"),
                F.col("value").alias("path"),
            ).alias("rules"),
            F.max_by("value", F.when(
                (F.col("kind") == "crawl-delay") & F.col("value").rlike("^[0-9]+$"), F.col("line")
            )).alias("delay"),
            F.count_if(F.col("kind") != "user-agent").alias("_lines"),
        )
        .filter(F.col("_lines") > 0)
        .select(
            key,
            F.struct(
                "group_id",
                F.transform("agents", lambda a: a["agent"]).alias("agents"),
                F.transform("rules", lambda r: F.struct(r["allow"].alias("allow"), U.decoded(r["path"]).alias("path"))).alias("rules"),
                F.nullif(F.col("delay").try_cast("double"), F.lit(0.0)).alias("delay"),
            ).alias("group"),
        )
        .groupBy(key)
        .agg(F.array_sort(F.collect_list("group")).alias("groups"))
    )
    maps = rules.filter(F.col("kind") == "sitemap").groupBy(key).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("line", "value"))), lambda s: s["value"]
        ).alias("sitemaps")
    )
    return groups.join(maps, key, "full_outer").withColumn(
        "sitemaps", F.coalesce("sitemaps", F.array().cast("array<string>"))
    )


def group_for(groups: Column, agent: Column) -> Column:
    """The group that speaks to ``agent``; null when none does."""

    def pick(name: Column) -> Column:
        def starred(g: Column) -> Column:
            return F.array_contains(g["agents"], "*")

        def addressed(g: Column) -> Column:
            return ~starred(g) & F.exists(g["agents"], lambda a: F.contains(name, a))

        return F.coalesce(
            F.get(F.filter(groups, addressed), F.lit(0)), F.get(F.filter(groups, starred), F.lit(0))
        )

    return X.let(F.lower(F.split_part(agent, F.lit("/"), F.lit(1))), pick)


def is_allowed(groups: Column, agent: Column, url: Column) -> Column:
    """First matching rule of the agent's group; anything unknown allows."""

    def decide(m: Column) -> Column:
        hit = F.filter(
            m["group"]["rules"], lambda r: (r["path"] == "*") | F.startswith(m["target"], r["path"])
        )
        return F.coalesce(F.get(hit, F.lit(0))["allow"], F.lit(True))

    return X.let(
        F.struct(group_for(groups, agent).alias("group"), U.decoded(U.request_target(url)).alias("target")), decide
    )


def single_copies(snapshots: DataFrame, key: list[str]) -> DataFrame:
    """One ``content`` per key out of any number of copies; repeats are combined before the shuffle.

    Parsing needs this: lines of two copies under one key would mix.
    """
    return snapshots.filter(F.col("http_status") == 200).groupBy(*key).agg(F.max("content").alias("content"))


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """Newest copy per domain; a copy that was not a 200 carries no rules."""
    newest = F.struct("fetched_at", "http_status", "content")
    return snapshots.groupBy("domain").agg(
        F.max("fetched_at").alias("fetched_at"),
        F.max_by(F.when(F.col("http_status") == 200, F.col("content")), newest).alias("content"),
    )


def check_requests(
    requests: DataFrame,
    files: DataFrame,
    on: list[str],
    request_key: str,
    respect: bool = True,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Add ``allowed``, ``robots_delay`` and ``sitemaps`` to ``(domain, url, user_agent, respect_robots_txt)`` rows.

    ``files`` has one row per join key with all its groups, so a request stays one
    row, however many rules its domain has.
    """
    joined = spread_join(requests, files, on, request_key, counted=counted)
    agent = F.coalesce("user_agent", F.lit(""))
    obeys = F.col("respect_robots_txt") & F.lit(respect)
    return joined.withColumns({
        "allowed": ~F.coalesce(obeys, F.lit(True)) | is_allowed(F.col("groups"), agent, F.col("url")),
        "robots_delay": group_for(F.col("groups"), agent)["delay"],
        "sitemaps": F.coalesce("sitemaps", F.array().cast("array<string>")),
    }).drop("groups")


def fresh_snapshot(
    requests: DataFrame, snapshots: DataFrame, ttl_seconds: int = ROBOTS_TTL_SECONDS, chunks: int | None = None
) -> DataFrame:
    """Add ``snapshot_us``: the newest copy of the request's domain still valid at its time.

    Both sides are merged into one time line per domain and the newest fetch time
    is carried along it: no pairs of requests and copies are formed, and a domain
    with very many of either is split into chunks.
    """
    line = requests.select("request_id", "domain", F.col("arrival_us").alias("at_us"),
                           F.lit(None).cast("long").alias("fetched_us"), F.lit(1).alias("side")).unionByName(
        # Copies of one fetch count once, so no instant gathers more than its requests.
        snapshots.select("domain", "fetched_us").distinct().select(
            F.lit(None).cast(requests.schema["request_id"].dataType).alias("request_id"),
            "domain", F.col("fetched_us").alias("at_us"), "fetched_us", F.lit(0).alias("side"),
        )
    )
    order = ["at_us", "side", "request_id"]
    seen = running_max(line, "domain", order, "fetched_us", "latest_us", chunks)
    fresh = F.col("at_us") < F.col("latest_us") + ttl_seconds * 1_000_000
    return seen.filter(F.col("side") == 1).select(
        "request_id", "domain", F.col("at_us").alias("arrival_us"),
        F.when(fresh, F.col("latest_us")).alias("snapshot_us"),
    )


def robots_checks(checked: DataFrame) -> DataFrame:
    return checked.groupBy("domain", "allowed").agg(F.count(F.lit(1)).alias("checks"))
