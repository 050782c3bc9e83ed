"""Skewed keys and components."""

import pytest
from pyspark.sql import functions as F

from lexloom.llm import common


@pytest.fixture
def many(spark):
    """A third of the rows has one key, some have none."""
    return spark.range(6000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") + 100).alias("k"), F.col("id").alias("v")).repartition(4)


def test_heavy(spark, many):
    assert common.heavy(many, "k") == [7]
    assert common.heavy(many.where("k <> 7"), "k") == []
    assert common.heavy(many.limit(0), "k") == []


def test_join_skewed_is_a_join(spark, many):
    few = many.select("k").where("k IS NOT NULL").distinct().where("k % 2 = 1").withColumn("w", F.col("k") * 2)
    got = sorted(tuple(r) for r in common.join_skewed(many, few, "k").select("k", "v", "w").collect())
    assert got == sorted(tuple(r) for r in many.join(few, "k").select("k", "v", "w").collect()) and len(got) > 2000


@pytest.mark.parametrize("native", [True, False])
def test_components_of_a_hub_and_a_chain(spark, native):
    """A hub with thousands of links, and a chain whose ids jump."""
    chain = [20_000 + i * 7 % 40 for i in range(40)]
    hub = spark.range(1, 3001).select(F.lit(5000).cast("long").alias("a"), F.col("id").alias("b"))
    links = hub.unionByName(spark.createDataFrame([*zip(chain, chain[1:]), (9, 9)], "a long, b long"))
    got = {r["node"]: r["root"] for r in common.components(links, native).collect()}
    assert got == {**{i: 1 for i in [*range(1, 3001), 5000]}, **{i: 20_000 for i in chain}}


def test_no_links(spark):
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shuffle_files_go_as_a_table_is_written(spark):
    """They were there all through the next step, as one collection of garbage doesn't free them: too much disk in line dedup and the pipeline."""
    import glob
    import os

    at = os.path.dirname(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])

    def files() -> set[str]:
        return set(glob.glob(f"{at}/**/shuffle_*.data", recursive=True))

    before, was = files(), spark.conf.get(common.CLEANUP, None)
    out = common.materialize(spark.range(20_000).groupBy((F.col("id") % 5000).alias("k")).count(), "counts")
    assert not files() - before
    assert spark.conf.get(common.CLEANUP, None) == was
    assert out.count() == 5000 and out.agg(F.sum("count")).first()[0] == 20_000
