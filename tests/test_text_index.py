from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from pagemill.functions import stemming as S
from pagemill.operators import text_index as TI
from pagemill.plans.scratch import scratch_path

# Published pairs of words and stems.
STEMS = """consign consign consigned consign consigning consign consignment consign consistency consist consistently consist
consolation consol consolatory consolatori consolidating consolid consolingly consol consonant conson conspicuously conspicu
conspiracy conspiraci conspirators conspir constables constabl constancy constanc knackeries knackeri knavish knavish
kneaded knead kneeling kneel knees knee knightly knight knitting knit knives knive knocker knocker generally general
communication communic dying die skies sky happy happi hoping hope hopping hop relational relat cries cri ties tie by by
say say gas gas gaps gap kiwis kiwi inning inning innings inning exceedingly exceed rate rate controlling control rolled roll
beauty beauti boyish boyish flying fli syzygy syzygi""".split()
TEXTS = {
    1: "The running dogs were hopping over fences", 2: "A dog runs; the fence is hopeful", 3: "runner of dogs. Fenced",
    4: None, 5: "", 6: "the of and", 7: "dogs over the fences over dogs", 8: "Hunde über Zäune, dogs",
}


def test_published_stems(spark):
    pairs = list(zip(STEMS[::2], STEMS[1::2], strict=True))
    found = spark.createDataFrame(pairs, "x string, want string").withColumn("stem", S.stem("x")).collect()
    assert [(r["x"], r["stem"]) for r in found if r["stem"] != r["want"]] == []
    assert len(S.STOP_WORDS) == len(set(S.STOP_WORDS)) == 127


@pytest.fixture(scope="module")
def index(spark):
    path = scratch_path(spark, "index")
    rows = spark.createDataFrame([*TEXTS.items(), (None, "dogs")], "id long, text string")
    TI.build_index(rows, "id", F.col("text"), path, buckets=16)
    return path


def ids(spark, path, **parts):
    return sorted(r["id"] for r in TI.search(spark, path, TI.parse(spark, **parts)).collect())


def test_boolean_and_phrase_searches(spark, index):
    assert ids(spark, index, all="dog fence") == [1, 2, 3, 7]
    assert ids(spark, index, all="dogs", none="run") == [3, 7, 8]
    assert ids(spark, index, any="hop hopes runner") == [1, 2, 3]
    assert ids(spark, index, all="dogs", any="over zäune") == [8]  # a stop word is no term
    assert ids(spark, index, phrase="dog over a fence") == [2, 7]
    assert ids(spark, index, phrase="running dog") == [1]
    assert ids(spark, index, phrase="dogs running") == [2]
    assert ids(spark, index, phrase="dogs fences dogs") == []
    assert ids(spark, index, all="the of") == ids(spark, index, none="dog") == ids(spark, index, any="absent") == []


def test_ranks_rare_and_repeated_terms_first(spark, index):
    found = TI.ranked(spark, index, TI.parse(spark, any="dogs zäune hunde")).collect()
    assert [r["id"] for r in found][:2] == [8, 7] and len(found) == 5


def test_only_the_buckets_of_the_terms_are_read(spark, index):
    rows = TI._of(spark, f"{index}/postings", "word string, id long, places array<int>", "word", ["dogs"], 16)
    assert rows.count() == 4
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan()
    assert re.search(r"PartitionFilters: \[.*bucket#\d+", plan.toString()) and "word,dogs" in plan.toString()
    assert plan.collectLeaves().head().metrics().apply("numPartitions").value() == 1


def test_an_empty_table_is_searched(spark):
    path = scratch_path(spark, "index")
    TI.build_index(spark.createDataFrame([], "id long, text string"), "id", F.col("text"), path)
    assert ids(spark, path, all="dogs") == [] and TI.ranked(spark, path, TI.parse(spark, any="dogs")).count() == 0
    assert spark.read.parquet(f"{path}/told").first()["texts"] == 0
