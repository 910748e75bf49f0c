"""A lineage cut leaves a table behind, not the shuffles that made it."""

from pyspark.sql import functions as F

from codequarry.session import _CLEANUP, _WRITERS, cut


def shuffle_files(spark):
    return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").count(".data")


def test_cut_frees_its_shuffles(spark):
    counted = spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count()
    setting, before = spark.conf.get(_CLEANUP, "false"), shuffle_files(spark)
    written = cut(counted)
    assert shuffle_files(spark) <= before
    assert spark.conf.get(_CLEANUP, "false") == setting
    expected = sorted((k, len(range(k, 1000, 7))) for k in range(7))
    assert sorted(map(tuple, written.collect())) == expected == sorted(map(tuple, counted.collect()))


def last_plan(spark):
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    return runs.apply(runs.size() - 1).physicalPlanDescription()


def test_cut_by_kind_sorts_nothing(spark):
    """Kinds are written side by side: a sort of a task's rows would spill once they don't fit."""
    setting = spark.conf.get(_WRITERS, "0")
    rows = spark.range(1000).select("id", F.concat(F.lit("k"), (F.col("id") % 5).cast("string")).alias("kind"))
    written = cut(rows, ["kind"])
    plan = last_plan(spark)
    assert "InsertIntoHadoopFsRelationCommand" in plan and "Sort" not in plan
    assert spark.conf.get(_WRITERS, "0") == setting
    assert sorted((r.id, r.kind) for r in written.collect()) == [(i, f"k{i % 5}") for i in range(1000)]
    # More kinds than are written side by side.
    many = cut(rows.select("id", F.concat(F.lit("k"), (F.col("id") % 40).cast("string")).alias("kind")), ["kind"])
    assert sorted((r.id, r.kind) for r in many.collect()) == [(i, f"k{i % 40}") for i in range(1000)]
