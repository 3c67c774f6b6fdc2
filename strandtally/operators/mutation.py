"""Substitutions in sequences at a rate, and the rate at which two sets of sequences differ."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .inference import _hashed

_BASES = np.frombuffer(b"ACGT", np.uint8)


def mutate_letters(letters: np.ndarray, first: int, sequence: int, rate: float, seed: int) -> np.ndarray:
    """A part of a sequence that begins at place ``first``, with substitutions. Each place has its own random numbers, so
    gaps between substitutions are geometric and a sequence in parts changes as the whole one does."""
    place = np.arange(first, first + len(letters))
    at = np.flatnonzero(_hashed(seed, sequence, place, 1) < rate)
    number = np.searchsorted(_BASES, letters[at])
    known = _BASES[np.minimum(number, 3)] == letters[at]
    step = (1 + 3 * _hashed(seed, sequence, place[at], 2)).astype(np.int64)  # to one of the three other bases
    out = letters.copy()
    out[at] = np.where(known, _BASES[(number + step) % 4], _BASES[(4 * _hashed(seed, sequence, place[at], 3)).astype(np.int64)])
    return out


def mutate(targets: DataFrame, rate: float, seed: int = 1) -> DataFrame:
    """(tid, seq) of targets with substitutions at a rate; of (tid, from, seq), parts that begin at a place from."""
    parts = "from" in targets.columns
    if not 0 <= rate < 1:
        raise ValueError(f"a rate of {rate}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            first = pdf["from"] if parts else np.zeros(len(pdf), np.int64)
            pdf["seq"] = [None if s is None else mutate_letters(np.frombuffer(s.encode("latin-1", "replace"), np.uint8), int(a), int(t), rate, seed).tobytes().decode("latin-1") for t, a, s in zip(pdf["tid"], first, pdf["seq"], strict=True)]
            yield pdf

    own = targets.select("tid", *(["from"] if parts else []), "seq")
    return own.mapInPandas(run, own.schema)


def difference_rate(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: bases of targets (tid, seq) in both sets, places at which they differ, and their share."""
    both = a.select("tid", F.col("seq").alias("x")).join(b.select("tid", F.col("seq").alias("y")), "tid")
    apart = F.size(F.filter(F.arrays_zip(F.split("x", "").alias("x"), F.split("y", "").alias("y")), lambda z: z["x"] != z["y"]))
    n = both.agg(F.coalesce(F.sum(F.length("x")), F.lit(0)).alias("bases"), F.coalesce(F.sum(F.when(F.length("x") > 0, apart).otherwise(0)), F.lit(0)).alias("differences"))
    return n.withColumn("rate", F.col("differences") / F.nullif("bases", F.lit(0)))
