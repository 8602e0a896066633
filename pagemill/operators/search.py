"""Containment, full-text and trigram search, row by row; the trigram join and duplicate content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.plans.scratch import durable
from pagemill.plans.skew import spread_join
from pagemill.plans.unnest import keep, unnest


#: Grams of a side that every task may hold, some tens of MB.
SMALL_GRAMS = 500_000


def has_topic(topic: str, topics: str = "topics") -> Column:
    return F.exists(topics, lambda t: t["topic"] == topic)


def has_keyword(keyword: str, keywords: str = "keywords") -> Column:
    return F.array_contains(keywords, keyword)


def words_of(*texts: Column) -> Column:
    """Distinct lower-cased words of the texts joined by a blank, nulls as empty."""
    joined = F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts])
    return F.array_distinct(F.regexp_extract_all(F.lower(joined), F.lit(X.WORD), F.lit(0)))


def matches_words(query: str | Sequence[str], *texts: Column, any_word: bool = False) -> Column:
    """Whether the texts hold all (or any) of the query's words. No stemming."""
    terms = query.split() if isinstance(query, str) else list(query)
    wanted = F.array_distinct(F.array(*[F.lit(t.lower()) for t in terms]))
    found = words_of(*texts)
    if any_word:
        return F.arrays_overlap(found, wanted)
    return F.size(F.array_except(wanted, found)) == 0


def trigram_search(rows: DataFrame, column: str, query: str, floor: float = 0.3) -> DataFrame:
    """Rows whose text is similar to the query, with ``similarity``; one scan, no pairs."""
    score = X.similarity(F.col(column), F.lit(query))
    # Unnesting the kept score, rather than filtering on it, computes it once.
    kept = rows.withColumn("_kept", F.filter(F.array(score), lambda s: s >= floor))
    return unnest(kept, "_kept", *rows.columns, item="similarity").drop("place")


def trigram_sets(rows: DataFrame, key: str, column: str) -> DataFrame:
    """``text, copies, first, grams`` of every distinct text that has trigrams; equal texts are one row.

    ``key`` is unique, or no two texts share their least key: ``first`` names the text.
    """
    texts = rows.groupBy(F.col(column).alias("text")).agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first"))
    # Unnested in the outer form, so the filter does not build the trigrams again.
    grams = texts.withColumn("_g", F.array(X.trigrams(F.col("text"))))
    found = unnest(grams, "_g", "text", "copies", "first", item="grams").drop("place")
    return keep(found, F.size("grams") > 0)


def trigram_candidates(left: DataFrame, right: DataFrame, floor: float) -> DataFrame:
    """``a, b``: the texts of two ``trigram_sets``, by their first keys, that are worth comparing, each pair once.

    Grams are put in order of how many texts hold them. Two texts that are similar
    enough share a gram among the first ``n - ceil(floor * n) + 1`` of each side's
    ``n``, the rarest ones, so only these are posted: a gram, a key, a size, a place.
    A shared gram also tells how many more can be shared behind it, which leaves out
    texts of unfitting sizes and pairs that meet too late in their order.
    """
    held = (
        left.select(F.explode("grams").alias("gram")).unionByName(right.select(F.explode("grams").alias("gram")))
        .groupBy("gram").agg(F.count(F.lit(1)).alias("holding"))
    )

    def posted(side: DataFrame, name: str) -> DataFrame:
        ranked = (
            spread_join(side.select("first", F.explode("grams").alias("gram")), held, ["gram"], "first")
            .groupBy("first").agg(F.array_sort(F.collect_list(F.struct("holding", "gram"))).alias("by_rarity"))
        )
        size = F.size("by_rarity")
        # A hair below the bound, so that rounding can't shorten a prefix.
        prefix = F.slice("by_rarity", F.lit(1), size - F.ceil(size * floor - 1e-9).cast("int") + 1)
        rows = ranked.select(F.col("first").alias(name), size.alias(f"n_{name}"), F.posexplode(prefix).alias(f"at_{name}", "g"))
        return durable(rows.select(F.col("g.gram").alias("gram"), name, f"n_{name}", f"at_{name}"))

    met = spread_join(posted(left, "a"), posted(right, "b"), ["gram"], "a", how="inner")
    least = (F.col("n_a") + F.col("n_b")) * (floor / (1 + floor)) - 1e-9
    possible = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    fitting = (F.col("n_a") >= F.col("n_b") * floor - 1e-9) & (F.col("n_b") >= F.col("n_a") * floor - 1e-9)
    # The first gram a pair shares passes this bound if the pair is similar: what is shared stands at it or behind it.
    return met.filter(fitting & (possible >= least)).select("a", "b").distinct()


def _by_count(small: DataFrame, large: DataFrame) -> DataFrame:
    """``a, b, common`` of all pairs that share grams; ``small`` is of a checked size and goes to every task.

    All grams of a text of ``large`` stand in one task, so what it shares is added up
    before anything is shuffled.
    """
    here = F.broadcast(small.select(F.col("first").alias("a"), F.explode("grams").alias("gram")))
    rows = large.select(F.col("first").alias("b"), F.explode("grams").alias("gram"))
    return rows.join(here, "gram").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))


def trigram_join(left: DataFrame, right: DataFrame, floor: float = 0.3) -> DataFrame:
    """Pairs of texts of two ``trigram_sets`` whose similarity reaches ``floor``.

    ``left_text, right_text, left_first, right_first, pairs, similarity``; ``pairs`` counts the
    pairs of rows that a pair of texts stands for. A side of at most ``SMALL_GRAMS``
    grams is sent to every task and shared grams are counted; between larger sides the
    candidates are chosen by their rarest grams and compared.
    """
    left, right = durable(left), durable(right)
    size = F.coalesce(F.sum(F.size("grams")), F.lit(0))
    if left.agg(size).first()[0] <= SMALL_GRAMS:
        pairs = _by_count(left, right)
    elif right.agg(size).first()[0] <= SMALL_GRAMS:
        pairs = _by_count(right, left).withColumnsRenamed({"a": "b", "b": "a"})
    else:
        grams = trigram_candidates(left, right, floor)
        for key, side in (("a", left), ("b", right)):
            grams = grams.join(side.select(F.col("first").alias(key), F.col("grams").alias(f"grams_{key}")), key)
        pairs = grams.select("a", "b", F.size(F.array_intersect("grams_a", "grams_b")).alias("common"))
    sized = pairs
    for key, side in (("a", left), ("b", right)):
        sized = sized.join(side.select(F.col("first").alias(key), F.size("grams").alias(f"n_{key}")), key)
    similarity = F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))
    found = sized.withColumn("similarity", similarity).filter(F.col("similarity") >= floor)
    by_left = left.select(F.col("first").alias("a"), F.col("text").alias("left_text"), F.col("copies").alias("_l"))
    by_right = right.select(F.col("first").alias("b"), F.col("text").alias("right_text"), F.col("copies").alias("_r"))
    return found.join(by_left, "a").join(by_right, "b").select(
        "left_text", "right_text", F.col("a").alias("left_first"), F.col("b").alias("right_first"),
        (F.col("_l") * F.col("_r")).alias("pairs"), "similarity",
    )


def duplicate_content(pages: DataFrame, key: str, content_hash: Column) -> DataFrame:
    """Hashes seen more than once, with copies and first id; a huge group is combined map-side."""
    return (
        pages.select(key, content_hash.alias("content_hash"))
        .groupBy("content_hash")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_id"))
        .filter(F.col("copies") > 1)
    )
