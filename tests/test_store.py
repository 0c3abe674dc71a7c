"""Stored tables, locators and entry points."""

import os

from lorefield.operators.locator import suggest
from lorefield.session import discard, materialise, spread
from lorefield.sources import store


def test_replace_and_read(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "id long, v string, part string"
    store.append(spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], schema), path, "part")
    store.replace_partitions(spark.createDataFrame([(3, "c", "y")], schema), path, "part")
    table = store.read(spark, path, schema)
    assert sorted((r["id"], r["part"]) for r in table.collect()) == [(1, "x"), (3, "y")]
    keys = spark.createDataFrame([(1,), (1,), (9,), (None,)], "id long")
    assert [r["id"] for r in store.get_many(table, "id", keys).collect()] == [1]
    assert [r["id"] for r in store.missing(keys, table, "id").collect()] == [9]


def test_locators(spark):
    ch = spark.createDataFrame(
        [(1, "p", "1-1", "the red fox"), (2, "p", "2-2", "the blue fox\nand more"), (3, "p", "3-3", "the red fox"), (4, "q", "1-1", "the red fox"), (5, "p", "5-5", None), (None, "p", "6-6", "x")],
        "chunk_id long, path string, chunk_range string, text string",
    )
    got = {r["chunk_id"]: r["anchor"] for r in suggest(ch, ch).collect()}
    assert got == {1: "1-1", 2: "and", 3: "3-3", 4: "the", 5: "5-5"}


def test_materialise_and_spread(spark):
    df = spark.range(10).coalesce(1)
    assert spread(df).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert materialise(df, "t").count() == 10
    assert materialise(df.limit(0), "t").count() == 0


def test_entry_points(spark, sf):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_shuffles_of_a_step_go_with_it(spark):
    def shuffles():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for i in range(found.size()) if (n := found.apply(i).getName()).startswith("shuffle_") and n.endswith(".data")}

    before = shuffles()
    materialise(spark.range(1000).repartition(4, "id"), "t")
    assert not shuffles() - before


def test_discard(spark):
    table = materialise(spark.range(10), "t")
    files = [f.removeprefix("file:") for f in table.inputFiles()]
    assert files and all(os.path.exists(f) for f in files)
    discard(table)
    assert not any(os.path.exists(f) for f in files)
