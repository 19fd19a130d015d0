"""A third of all rows with one key: 200,000 rows of one id and text among 600,000."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from granary.llm import langid, mixing, sharding, substring_dedup
from granary.llm.scratch import written

WORDS = " ".join(f"w{i}" for i in range(60))


@pytest.fixture(scope="module")
def hot(spark):
    same = spark.range(200_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(WORDS).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    rest = spark.range(400_000).selectExpr("id + 1000 AS doc_id", "concat('doc ', id, ' has words of its own') AS text", "if(id % 2 = 0, 'en', 'de') AS lang", "concat('s', id % 9) AS source")
    return written(same.unionByName(rest).repartition(8), "hot")


def test_mixing(hot):
    taken = mixing.mixed(hot)[1]
    by = {r["source_size"]: r for r in taken.groupBy("source_size").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"), F.count("*").alias("n")).collect()}
    assert sum(r["n"] for r in by.values()) == 600_000 and by[200_000 * 60]["n"] == 200_000
    sources = taken.select("source_size", "target").distinct().count()
    assert sources >= 3 and abs(by[200_000 * 60]["taken"] - by[200_000 * 60]["target"]) <= 1


def test_substring_dedup(hot):
    found = substring_dedup.without_repeats(hot).agg(F.count("*"), F.sum("n_removed"), F.sum((F.col("kept") == WORDS).cast("int"))).first()
    assert tuple(found) == (600_000, 0, 200_000)  # rows of one id don't remove from each other


def test_sharding(hot):
    counts = [r["count"] for r in sharding.sharded(hot).groupBy("shard").count().collect()]
    assert len(counts) == 24 and set(counts) == {25_000}


def test_language_sample(hot):
    assert langid.fit(hot).languages == ["de", "en"]
