"""Facts of a run: how formats agree, and digests of the targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formats

MOST_BIAS, MOST_INCOMPATIBLE = 0.01, 0.05  # fixed values: beyond these a warning is given


def format_agreement(observed: DataFrame, expected: str) -> DataFrame:
    """One row on alignments (frag, format): fragments with a compatible alignment, those on either strand, and warnings.

    strand_bias: how far the share of the first strand is from one half; the warning is only for unstranded formats."""
    _, orientation, strand = formats.FORMATS[expected]
    first = next(c for c, (k, o, s) in formats.FORMATS.items() if o == orientation and s in ("SA", "S"))
    second = next(c for c, (k, o, s) in formats.FORMATS.items() if o == orientation and s in ("AS", "A"))
    f = F.col("format")
    frag = observed.groupBy("frag").agg(F.bool_or(formats.compatible_pair(expected, f)).alias("ok"), F.bool_or(f == first).alias("sf"), F.bool_or(f == second).alias("sr"))
    n = frag.agg(F.count("*").alias("fragments"), F.count_if("ok").alias("compatible"), F.count_if("sf").alias("sense"), F.count_if("sr").alias("antisense"))
    ratio = F.col("compatible") / F.nullif("fragments", F.lit(0))
    bias = F.abs(F.col("sense") / F.nullif(F.col("sense") + F.col("antisense"), F.lit(0)) - 0.5)
    return n.select(
        F.lit(expected).alias("expected"), "fragments", "compatible", ratio.alias("ratio"), "sense", "antisense", bias.alias("strand_bias"),
        (F.lit(strand == "U") & (bias > MOST_BIAS)).alias("warn_strand"), (1 - ratio > MOST_INCOMPATIBLE).alias("warn_incompatible"),
    )


def _field(name: str):
    return lambda v: v[name]


BLOCK = 65_536  # targets whose digests are digested together


def digests(targets: DataFrame) -> DataFrame:
    """One row: SHA-256 of the targets' sequences and of their names (tid, name, seq).

    Targets' own digests are joined in order and digested by blocks of BLOCK numbers, and these digests again."""
    own = targets.select("tid", F.sha2("seq", 256).alias("s"), F.sha2("name", 256).alias("n"))

    def joined(rows: DataFrame, order: str, by: list) -> DataFrame:
        listed = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, "s", "n"))).alias("x"))
        return listed.select(*(c.alias("b") for c in by), *(F.sha2(F.array_join(F.transform("x", _field(c)), ""), 256).alias(c) for c in "sn"))

    blocks = joined(own.withColumn("b", F.floor(F.col("tid") / BLOCK)), "tid", [F.col("b")])
    return joined(blocks, "b", []).select(F.col("s").alias("sequences"), F.col("n").alias("names"))
