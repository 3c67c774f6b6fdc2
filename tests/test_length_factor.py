"""The factor of a fragment's length, by broadcast tables."""

import math

from pyspark.sql import functions as F

from strandtally.functions.numeric import LOG_EPSILON
from strandtally.operators import likelihood


def test_alignments_are_not_shuffled_by_length(spark):
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")  # as where Spark doesn't know how small they are
    a = spark.range(40).select(F.col("id").alias("frag"), (F.col("id") % 4).cast("int").alias("frag_len"), (F.col("id") % 1 + 2).cast("int").alias("len"))
    table = spark.range(4).groupBy(F.col("id").cast("int").alias("length")).agg(F.sum(F.lit(0.25)).alias("p")).withColumn("c", (F.col("length") + 1) / 4.0)
    out = likelihood.fragment_factor(a, table.select("length", "p"), table.select("length", "c"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    spark.conf.set(threshold, before)
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan
    want = math.log(0.25) - math.log(0.75)
    got = {r.frag: r.log_fl for r in out.collect()}
    assert len(got) == 40 and all(math.isclose(v, want) if i % 4 <= 2 else v == LOG_EPSILON for i, v in got.items())
