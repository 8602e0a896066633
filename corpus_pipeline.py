"""The corpus pipeline: toxicity, near duplicates, personal data, mixing, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage
before it kept; all but the last return the columns of ``docs``. ``run`` writes
each stage's rows to the shared scratch folder and reads them again, so a lost
executor costs at most one stage. An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm import hyperminhash, pii, systematic_mix, toxicity, vector_packing
from pagemill.llm.catalog import tokenizer_path
from pagemill.llm.frames import fresh, table, text_of
from pagemill.plans.scratch import scratch_path

#: Some stages have no SQL form; tests hold the whole run against a plain one.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose toxicity score reaches the bound of rejection."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = fresh("score")
    return toxicity.with_score(docs, model, score).filter(F.col(score) < toxicity.REJECT).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every group of near duplicates, the one with the least id: 80 % of shingles of five words.

    A document is an id with a text: rows of one id whose texts differ are judged
    each by its own text, the least digest first among equal ids. Rows equal in both
    (a null text counts as empty) leave one row, the least by a hash of its hashable columns. Rows without an id
    can't be told apart and stay.
    """
    written = F.col("doc_id").cast("string")
    name, rest = fresh("node"), [f.name for f in docs.schema.fields if not _holds_map(f.dataType)]
    # Ids by length, then by digits: the order of numbers from 0. The digest tells the texts of one id apart.
    node = F.concat(F.lpad(F.length(written).cast("string"), 10, "0"), written, F.lit("/"), F.hex(F.xxhash64(text_of())))
    named = docs.withColumn(name, node)
    kept = (
        hyperminhash.near_duplicates(named.select(F.col(name).alias("doc_id"), "text"), k=5, percent=80)
        .filter("kept").select(F.col("doc_id").alias(name)).distinct()
    )
    one = F.min_by(F.struct(*docs.columns), F.xxhash64(*rest)).alias("_row")
    chosen = named.join(kept, name, "left_semi").groupBy(name).agg(one).select("_row.*")
    return chosen.unionByName(docs.filter(F.col("doc_id").isNull())).select(*docs.columns)


def _holds_map(kind: T.DataType) -> bool:
    """Whether a column has a map anywhere inside, which can't be hashed."""
    return "map<" in kind.simpleString()


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the name of its kind in place of every plain or disguised identifier."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as its source's target says."""
    return systematic_mix.emit(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences."""
    return vector_packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"corpus-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
