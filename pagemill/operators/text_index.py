"""A full-text index on files: postings by stem, searched without reading the texts.

``build_index`` writes a row per (word, id) with the word's positions, which count
all words, and a lexicon of the words' stems; stop words are left out. A word is
stemmed once, however often it occurs. Both tables are stored by a hash, of the word
and of the stem, and sorted by it: a search reads the forms of its stems, then the
folders of these words, and there the row groups that hold them. A bucket that a
common word fills is written by as many tasks as its size asks for. A search groups
what it read by id; no group is larger than its terms.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.functions.stemming import STOP_WORDS, stem

BUCKETS = 64


def words_at(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """``key, place, word`` of every word, places counted from 1; null texts have none."""
    words = F.regexp_extract_all(F.lower(text), F.lit(X.WORD), F.lit(0))
    found = rows.select(F.col(key), F.posexplode_outer(words).alias("place", "word")).filter(F.col("place").isNotNull())
    return found.withColumn("place", F.col("place") + 1)


def counted(words: DataFrame) -> DataFrame:
    return words.filter(~F.col("word").isin(STOP_WORDS))


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build_index(rows: DataFrame, key: str, text: Column, path: str, buckets: int = BUCKETS) -> None:
    """Index ``text`` of every row under ``key``, which is unique; rows without one are left out."""

    def write(table: DataFrame, by: str, name: str) -> None:
        (
            table.withColumn("bucket", bucket_of(F.col(by), buckets)).hint("rebalance", "bucket")
            .sortWithinPartitions("bucket", by).write.partitionBy("bucket").parquet(f"{path}/{name}")
        )

    keyed = rows.filter(F.col(key).isNotNull())
    words = counted(words_at(keyed, key, text))
    write(words.groupBy("word", F.col(key).alias("id")).agg(F.array_sort(F.collect_list("place")).alias("places")), "word", "postings")
    known = rows.sparkSession.read.schema("word string").parquet(f"{path}/postings").distinct()
    write(known.withColumn("term", stem("word")), "term", "lexicon")
    told = keyed.agg(F.countDistinct(key).alias("texts"), F.max(key).alias("id")).withColumn("buckets", F.lit(buckets))
    told.write.parquet(f"{path}/told")


@dataclass(frozen=True)
class Query:
    """Stems that all, any or none have to occur, and phrases as (place, stem)."""

    all: tuple[str, ...] = ()
    any: tuple[str, ...] = ()
    none: tuple[str, ...] = ()
    phrase: tuple[tuple[int, str], ...] = ()

    @property
    def terms(self) -> list[str]:
        return sorted({*self.all, *self.any, *self.none, *(t for _, t in self.phrase)})


def parse(spark: SparkSession, **parts: str) -> Query:
    """A query from the words of its parts, stop words left out; a phrase keeps their distances."""
    asked = spark.createDataFrame(list(parts.items()), "part string, words string")
    words = counted(words_at(asked, "part", F.col("words"))).withColumn("term", stem("word"))
    found = words.orderBy("part", "place").collect()
    told: dict[str, list] = {part: [] for part in parts}
    for r in found:
        told[r["part"]].append((r["place"], r["term"]) if r["part"] == "phrase" else r["term"])
    return Query(**{part: tuple(terms) for part, terms in told.items()})


def _of(spark: SparkSession, path: str, schema: str, column: str, values: list[str], buckets: int) -> DataFrame:
    """The rows of a table whose ``column`` is among ``values``; other folders are not opened."""
    named = spark.createDataFrame([(v,) for v in values], "v string")
    homes = [r[0] for r in named.select(bucket_of(F.col("v"), buckets)).distinct().collect()]
    # The schema is given, since a table without rows has no file to tell it.
    rows = spark.read.schema(f"{schema}, bucket int").parquet(path)
    return rows.filter(F.col("bucket").isin(homes) & F.col(column).isin(values)).drop("bucket")


def postings_of(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """``term, id, places`` of the given stems."""
    told = spark.read.parquet(f"{path}/told")
    buckets = told.first()["buckets"]
    # Words of one stem differ by the endings that the stemmer knows, so they are few.
    forms = _of(spark, f"{path}/lexicon", "word string, term string", "term", terms, buckets).collect()
    schema = f"word string, id {dict(told.dtypes)['id']}, places array<int>"
    rows = _of(spark, f"{path}/postings", schema, "word", [f["word"] for f in forms], buckets)
    stems = spark.createDataFrame([(f["word"], f["term"]) for f in forms], "word string, term string")
    return rows.join(F.broadcast(stems), "word").groupBy("term", "id").agg(
        F.array_sort(F.flatten(F.collect_list("places"))).alias("places")
    )


def search(spark: SparkSession, path: str, query: Query) -> DataFrame:
    """``id, found`` of the texts that the query describes; ``found`` lists ``term, places`` of its terms.

    A query of stop words alone, or of ``none`` alone, finds nothing.
    """
    if not (query.all or query.any or query.phrase):
        return postings_of(spark, path, []).select("id", F.array(F.struct("term", "places")).alias("found"))
    per_id = postings_of(spark, path, query.terms).groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("term", "places"))).alias("found")
    )

    def listed(terms: tuple[str, ...]) -> Column:
        return F.array(*map(F.lit, sorted(set(terms))))

    def places(term: str) -> Column:
        return F.flatten(F.transform(F.filter("found", lambda f: f["term"] == term), lambda f: f["places"]))

    def moved(found: Column, back: int) -> Column:
        return F.transform(found, lambda p: p - back)

    held = F.transform("found", lambda f: f["term"])
    conditions = []
    if query.all:
        conditions.append(F.size(F.array_except(listed(query.all), held)) == 0)
    if query.any:
        conditions.append(F.arrays_overlap(held, listed(query.any)))
    if query.none:
        conditions.append(~F.arrays_overlap(held, listed(query.none)))
    if query.phrase:
        first, term = query.phrase[0]
        starts = places(term)
        for place, term in query.phrase[1:]:
            starts = F.array_intersect(starts, moved(places(term), place - first))
        conditions.append(F.size(starts) > 0)
    for condition in conditions:
        per_id = per_id.filter(condition)
    return per_id


def ranked(spark: SparkSession, path: str, query: Query) -> DataFrame:
    """``id, score, rank`` of what the query finds: rare terms and repeated ones weigh more, ties by id."""
    wanted = sorted({*query.all, *query.any, *(t for _, t in query.phrase)})
    found = search(spark, path, query).select("id", F.explode("found").alias("f")).filter(F.col("f.term").isin(wanted))
    texts = spark.read.parquet(f"{path}/told").first()["texts"]
    df = postings_of(spark, path, wanted).groupBy("term").agg(F.count(F.lit(1)).alias("holding"))  # a row per query term
    n = F.size("f.places")
    weight = F.log(1 + F.lit(texts) / F.col("holding")) * n / (n + 1)
    scored = (
        found.join(F.broadcast(df), F.col("f.term") == F.col("term"))
        .groupBy("id").agg(F.round(F.sum(weight), 6).alias("score"))
    )
    return scored.orderBy(F.desc("score"), "id")
