"""Abundance tables: normalisation, genes, samples, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import value_ranks


def tpm(counts: DataFrame) -> DataFrame:
    """``counts`` (num_reads, eff_len) with tpm: rates by effective length, a million in all; 0 for targets without length."""
    rate = F.when(F.col("eff_len") > 0, F.col("num_reads") / F.col("eff_len")).otherwise(0.0)
    whole = counts.agg(F.sum(rate).alias("whole"))  # one row
    return counts.withColumn("rate", rate).crossJoin(F.broadcast(whole)).withColumn("tpm", F.coalesce(F.col("rate") / F.nullif(F.col("whole"), F.lit(0.0)) * 1e6, F.lit(0.0))).drop("rate", "whole")


def table(counts: DataFrame, digits: int = 3, tpm_digits: int = 6) -> DataFrame:
    """name, length, effective_length, tpm, num_reads as they are written."""
    return tpm(counts).select("name", "length", F.round("eff_len", digits).alias("effective_length"), F.round("tpm", tpm_digits).alias("tpm"), F.round("num_reads", digits).alias("num_reads"))


def empty_table(targets: DataFrame) -> DataFrame:
    """The table when too few fragments were assigned."""
    return targets.select("name", "length", F.col("length").cast("double").alias("effective_length"), F.lit(0.0).alias("tpm"), F.lit(0.0).alias("num_reads"))


def gene_table(abundances: DataFrame, genes: DataFrame) -> DataFrame:
    """Sums by gene; lengths are means weighted by TPM, or plain ones for a gene without TPM. A target without a gene is its own."""
    named = abundances.join(genes, "name", "left").withColumn("gene", F.coalesce("gene", F.col("name")))
    t = F.sum("tpm")
    mean = lambda c: F.when(t > 0, F.sum(F.col(c) * F.col("tpm")) / F.nullif(t, F.lit(0.0))).otherwise(F.avg(c))
    return named.groupBy("gene").agg(mean("length").alias("length"), mean("effective_length").alias("effective_length"), t.alias("tpm"), F.sum("num_reads").alias("num_reads"))


def merge_samples(samples: dict[str, DataFrame], column: str, missing: str = "NA") -> DataFrame:
    """name by sample, with ``missing`` where a sample lacks a name. A name twice in a sample is an error."""
    return merge_long(_union(samples, column), list(samples), missing)


def _union(samples: dict[str, DataFrame], column: str) -> DataFrame:
    out = None
    for sample, df in samples.items():
        part = df.select("name", F.lit(sample).alias("sample"), F.col(column).alias("value"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no samples")
    return out


def merge_long(long: DataFrame, samples: list[str], missing: str = "NA") -> DataFrame:
    """The same from rows (name, sample, value)."""
    text = F.when(F.count("value") > 1, F.raise_error(F.lit("a name occurs twice in one sample"))).otherwise(F.max(F.col("value").cast("string")))
    return long.groupBy("name").pivot("sample", samples).agg(text).na.fill(missing, samples)


def correlation(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: pearson and spearman of two columns; tied ranks are averaged."""
    ranked = pairs.select(F.col(a).alias("a"), F.col(b).alias("b"))
    for c in "ab":
        ranks = value_ranks(ranked, c).select(F.col("value").alias(f"v{c}"), (F.col("upto") - (F.col("n") - 1) / 2.0).alias(f"r{c}"))
        ranked = ranked.join(ranks, F.col(c).eqNullSafe(F.col(f"v{c}"))).drop(f"v{c}")
    return ranked.agg(F.corr("a", "b").alias("pearson"), F.corr("ra", "rb").alias("spearman"))


def table_or_empty(counted: DataFrame, assigned: int, least: int = 10) -> tuple[DataFrame, list[str]]:
    """The abundance table of ``counted``, or that of its targets without any fragment where fewer than ``least`` fragments
    were assigned, with the errors to be reported."""
    if assigned >= least:
        return table(counted), []
    return empty_table(counted.select("name", "length")), ["insufficient_assigned_fragments"]
