"""Models of bias are made by all cores, however few bytes the targets have."""

from strandtally.plans import queries

from .test_queries import DATA


def test_targets_are_dealt_out(spark):
    targets = queries.bias_tables(spark, DATA)[1]
    assert targets.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    sizes = targets.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert max(sizes) < sum(sizes) / 2


def test_observed_models_use_all_cores(spark):
    from strandtally.operators import bias

    fragments = spark.createDataFrame([(i, 10, 60, 1.0) for i in range(40)], "tid long, start long, stop long, w double")
    targets = spark.createDataFrame([(i, "ACGTTGCA" * 12, i % 5) for i in range(40)], "tid long, seq string, length_class int")
    plan = bias.observed_models(fragments, targets)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
