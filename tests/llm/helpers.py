"""Small tables with the awkward rows every operator has to take."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators might use inside.
CLASHES = "band long, node long, anchor long, chunk int, score double, copies long, size long, target double, word string"


def documents(spark, texts, ids=None, sources=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [
        (i, t, "en", "s" if sources is None else sources[n], None if t is None else len(t))
        for n, (i, t) in enumerate(zip(ids, texts, strict=True))
    ]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    long = " ".join(f"w{i % 977}" for i in range(20_000))
    rows = [
        (1, "one two three four five six seven", "en", "a", 33),
        (1, "one two three four five six seven", "en", "a", 33),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, long, "en", "b", len(long)),
        (5, long, None, "b", len(long)),
        (None, "one two three four five six seven", "en", None, None),
        (6, " \t\n ", "en", "c", 4),
        (7, "é" * 300, "fr", "c", 300),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(docs):
    """The same rows with further columns under names that operators use inside."""
    from pyspark.sql import functions as F

    pairs = [c.split() for c in CLASHES.split(", ")]
    return docs.select("*", *[F.lit(7).cast(kind).alias(name) for name, kind in pairs])


def rows(df, *columns):
    names = columns or df.columns
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
