"""How likely an alignment of a fragment is, and the shares of a fragment's alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import LOG_EPSILON


def log_start(length: Column, fragment: Column) -> Column:
    """Logarithm of the chance of a start on a target of some length."""
    return F.when(fragment <= length, -F.log(F.greatest(length - fragment + 1, F.lit(1)).cast("double"))).otherwise(LOG_EPSILON)


def fragment_factor(alignments: DataFrame, pmf: DataFrame, cmf: DataFrame) -> DataFrame:
    """``alignments`` (frag_len, len) with log_fl: the length's mass, given that it fits on the target.

    pmf (length, p) and cmf (length, c) are small tables over all lengths, which are broadcast, as a shuffle by length
    would have as few keys as there are lengths; beyond the longest, that one counts."""
    top = F.lit(1_000)
    p = pmf.select(F.col("length").alias("__l"), "p")
    c = cmf.select(F.col("length").alias("__m"), "c")
    joined = alignments.join(F.broadcast(p), F.least("frag_len", top) == F.col("__l"), "left").join(F.broadcast(c), F.least("len", top) == F.col("__m"), "left")
    value = F.when((F.col("frag_len") <= F.col("len")) & (F.col("p") > 0) & (F.col("c") > 0), F.log("p") - F.log("c")).otherwise(LOG_EPSILON)
    return joined.withColumn("log_fl", value).drop("__l", "__m", "p", "c")


def log_ambiguous_length(cmf_most: Column, cmf_target: Column) -> Column:
    """For a read without a mate: the chance that the fragment is no longer than fits where the read lies."""
    return F.when((cmf_most > 0) & (cmf_target > 0), F.log(cmf_most) - F.log(cmf_target)).otherwise(LOG_EPSILON)


def log_alignment(estimate: Column) -> Column:
    """Logarithm of an alignment's own probability; 0 where there is no positive one."""
    return F.when(estimate > 0, F.log(estimate)).otherwise(0.0)


def posterior(alignments: DataFrame, log_p: str = "log_p") -> DataFrame:
    """With p, an alignment's share of its fragment; fragments without any probability are left out."""
    w = Window.partitionBy("frag")
    top = F.max(log_p).over(w)
    e = alignments.withColumn("__top", top).filter(F.col("__top") > float("-inf")).withColumn("__e", F.exp(F.col(log_p) - F.col("__top")))
    return e.withColumn("p", F.col("__e") / F.sum("__e").over(w)).drop("__top", "__e")


def impossible_fragments(alignments: DataFrame, log_p: str = "log_p") -> DataFrame:
    """Fragments none of whose alignments has a probability."""
    return alignments.groupBy("frag").agg(F.max(log_p).alias("m")).filter(F.col("m").isNull() | (F.col("m") == float("-inf"))).select("frag")


def strand_mass(posteriors: DataFrame) -> DataFrame:
    """(fwd, mass): posterior mass by strand."""
    return posteriors.groupBy("fwd").agg(F.sum("p").alias("mass"))


def error_rates(bases: DataFrame) -> DataFrame:
    """(bin, prev, cur, p): transitions between alignment states by position in the read, from rows (bin, prev, cur, mass)."""
    sums = bases.groupBy("bin", "prev", "cur").agg(F.sum("mass").alias("m"))
    return sums.select("bin", "prev", "cur", (F.col("m") / F.sum("m").over(Window.partitionBy("bin", "prev"))).alias("p"))


def error_likelihood(bases: DataFrame, rates: DataFrame, baseline: float) -> DataFrame:
    """(frag, log_err): sum of the transitions' logarithms over that of as many matches; bases has frag, bin, prev, cur."""
    joined = bases.join(rates, ["bin", "prev", "cur"], "left")
    return joined.groupBy("frag").agg(F.sum(F.coalesce(F.log("p"), F.lit(LOG_EPSILON)) - baseline).alias("log_err"))
