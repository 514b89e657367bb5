from pathlib import Path

from treegrain.session import discard, fresh_names, materialize, purge, shared_dir, spill_table, spread


def test_tables_in_the_shared_folder(spark):
    df = spark.range(10).selectExpr("id", "CAST(id AS STRING) AS s")
    kept = spill_table(spark, df, "test")
    assert kept.dtypes == df.dtypes and kept.count() == 10
    (file,) = {f.rpartition("/test-")[0] for f in kept.inputFiles()}
    assert file.rpartition("/")[2] == shared_dir(spark).rpartition("/")[2]
    purge(spark)
    assert spill_table(spark, df, "test").count() == 10


def test_tables_on_the_way_go(spark):
    made = []

    def make():
        made.append(spill_table(spark, spark.range(5), "step"))
        return made[0].where("id > 1")

    folders = lambda df: {Path(f.removeprefix("file:")).parent for f in df.inputFiles()}
    kept = materialize(spark, make, "result")
    assert kept.count() == 3 and not any(f.exists() for f in folders(made[0]))
    where = folders(kept)
    discard(kept)
    assert where and not any(f.exists() for f in where)


def test_names_and_partitions(spark):
    df = spark.createDataFrame([(1, 2)], "A int, a_ int")
    assert fresh_names(df, "a", "b", "B") == ["a__", "b", "B_"]
    assert spread(df.coalesce(1)).rdd.getNumPartitions() == 4 and spread(spark.range(10, numPartitions=9)).rdd.getNumPartitions() == 9
