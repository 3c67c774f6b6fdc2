"""Quality rules with adaptive thresholds (operator 10).

Each text gets counts (words, characters, symbols, repeated lines, repeated
word windows). Ratios of these counts are gathered in mergeable quantile
sketches, one per language, source and ratio: logarithmic bins with counts, so
that two sketches merge by adding bins and a quantile is off by one bin width at
most, whatever the order of merging. A text is rejected by the base rules, or
when a ratio lies beyond the upper fence of its own language and source. The
fewer texts a group has, the nearer its fence is drawn to that of its language,
and that to the fence of all texts.

Edge cases: a null or empty text has no words and fails the base rules; null
language or source form groups of their own; repeated rows are judged one by
one; columns of the input named like a count are kept aside from the counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import free_prefix, stored
from .wordscan import per_doc, scan, slices, span_hashes, windows

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FENCE = "__fence_"
#: Groups of language and source up to which the fences are broadcast (some 100 bytes each); more are shuffled.
MOST_BROADCAST = 100_000
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rules:
    """min_words, most_repeated: base rules. fence: a ratio may exceed the upper
    quartile by this many times the larger of the interquartile range and of
    ``floor``. weight: a group of n texts takes n / (n + weight) of its own fence
    and the rest from its language's, as that does from the fence of all texts.
    width: relative width of a sketch's bins."""

    min_words: int = 50
    most_repeated: float = 50.0
    fence: float = 6.0
    weight: float = 10.0
    width: float = 0.02
    floors: tuple[tuple[str, float], ...] = (("symbol_ratio", 0.004), ("dup_line_ratio", 0.02), ("repeat_ratio", 0.05), ("long_words", 0.6))


def count_batch(texts: pa.Array) -> dict[str, np.ndarray]:
    """The five counts of each text of an Arrow column."""
    w = scan(texts, lower=False)
    n = len(w.offsets) - 1

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[w.offsets[1:]] - sums[w.offsets[:-1]]

    # lines: from a text's start or after a line feed, up to the next line feed
    feed = w.data == 10
    is_start = np.zeros(len(w.data) + 1, bool)
    is_start[1:] = feed
    is_start[w.offsets[:-1]] = True
    line = np.flatnonzero(is_start[:-1])
    dup = np.zeros(n, np.int64)
    if len(line):
        stop = np.append(line[1:], len(w.data))
        sums = np.concatenate([[0], np.cumsum(w.inside, dtype=np.int64)])
        full = sums[stop] > sums[line]
        stop = stop - feed[stop - 1]
        h = span_hashes(w.data, line, stop, ~feed)[full]
        doc = (np.searchsorted(w.offsets, line[full], side="right") - 1).astype(np.int64)
        _, at = np.unique(per_doc(h, doc), return_index=True)
        dup = np.bincount(doc, minlength=n) - np.bincount(doc[at], minlength=n)

    h, at = windows(w.hashes(), w.first)
    repeated = np.zeros(len(w.starts) + 3, bool)
    if len(at):
        key = per_doc(h, w.doc[at])
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            repeated[at[twice] + k] = True
    hit = np.flatnonzero(repeated[: len(w.starts)])
    return {
        "n_words": np.diff(w.first),
        "word_chars": total(w.inside & ((w.data & 0xC0) != 0x80)),
        "n_symbols": total(SYMBOLS[w.data]),
        "n_dup_lines": dup,
        "n_repeat_words": np.bincount(w.doc[hit], minlength=n),
    }


def with_counts(docs: DataFrame, prefix: str = "") -> DataFrame:
    """``docs`` with the counts as further columns ``prefix`` + name."""
    schema = T.StructType([*docs.schema.fields, *(T.StructField(prefix + c, T.LongType()) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                got = count_batch(part.column("text"))
                names = [*part.schema.names, *(prefix + c for c in COUNTS)]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(got[c].astype(np.int64)) for c in COUNTS)], names=names)

    return docs.mapInArrow(run, schema)


def ratios(prefix: str = "") -> dict[str, Column]:
    c = {x: F.col(prefix + x).cast("double") for x in COUNTS}
    words = F.greatest(c["n_words"], F.lit(1.0))
    return {
        "symbol_ratio": c["n_symbols"] / F.greatest(c["word_chars"], F.lit(1.0)),
        "dup_line_ratio": c["n_dup_lines"] / words,
        "repeat_ratio": c["n_repeat_words"] / words,
        "long_words": c["word_chars"] / words,
    }


def base_failed(rules: Rules, prefix: str = "") -> Column:
    n, r = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (n < rules.min_words) | (r * 100 > n * rules.most_repeated)


def fences(counted: DataFrame, rules: Rules, prefix: str = "") -> DataFrame:
    """Upper fences by language, source and ratio, from sketches of all texts that pass the base rules.

    One row for each language and source, with a column for each ratio."""
    bin_of = lambda x: F.when(x <= 1e-6, F.lit(-10_000)).otherwise(F.floor(F.log(x) / F.log1p(F.lit(rules.width))).cast("int"))
    names = [n for n, _ in rules.floors]
    r = ratios(prefix)
    long = counted.filter(~base_failed(rules, prefix)).select(
        F.col("lang").alias("g_lang"), F.col("source").alias("g_source"),
        F.explode(F.array(*(F.struct(F.lit(n).alias("ratio"), bin_of(r[n]).alias("bin")) for n in names))).alias("x"),
    ).select("g_lang", "g_source", "x.ratio", "x.bin")
    own = long.groupBy("g_lang", "g_source", "ratio", "bin").agg(F.count("*").alias("n"))
    own = stored(own, "quality-sketches")  # small: bins of groups, not texts
    floor = F.create_map(*(F.lit(v) for pair in rules.floors for v in pair))

    def fence(sketch: DataFrame, keys: list[str], mark: str) -> DataFrame:
        w = Window.partitionBy(*keys, "ratio")
        at = sketch.select(*keys, "ratio", "bin", "n", F.sum("n").over(w.orderBy("bin")).alias("upto"), F.sum("n").over(w).alias("all"))
        value = F.when(F.col("bin") == -10_000, 0.0).otherwise(F.pow(F.lit(1 + rules.width), F.col("bin") + 0.5))
        q = lambda p: F.min(F.when(F.col("upto") >= F.col("all") * p, value))
        q1, q3 = q(0.25), q(0.75)
        got = at.groupBy(*keys, "ratio").agg(F.max("all").alias("all"), (q3 + rules.fence * F.greatest(q3 - q1, F.element_at(floor, F.col("ratio")))).alias("top"))
        return got.groupBy(*keys).agg(F.max("all").alias(f"n_{mark}"), *(F.max(F.when(F.col("ratio") == n, F.col("top"))).alias(f"{n}_{mark}") for n in names))

    merged = lambda keys: own.groupBy(*keys, "ratio", "bin").agg(F.sum("n").alias("n"))
    a, b, c = fence(own, ["g_lang", "g_source"], "own"), fence(merged(["g_lang"]), ["g_lang"], "lang"), fence(merged([]), [], "all")
    out = a.alias("a").join(b.alias("b"), F.col("a.g_lang").eqNullSafe(F.col("b.g_lang"))).join(F.broadcast(c), F.lit(True))  # c is one row
    drawn = lambda n, mark, up: (F.col(f"n_{mark}") * F.col(f"{n}_{mark}") + rules.weight * up) / (F.col(f"n_{mark}") + rules.weight)
    top = [drawn(n, "own", drawn(n, "lang", F.col(f"{n}_all"))).alias(FENCE + n) for n in names]
    return stored(out.select(F.col("a.g_lang").alias(FENCE + "lang"), F.col("a.g_source").alias(FENCE + "source"), F.col("n_own").alias(FENCE + "n"), *top), "quality-fences")


def within_fences(counted: DataFrame, tops: DataFrame, rules: Rules, prefix: str = "") -> DataFrame:
    """``counted`` with ``base_failed`` and ``kept`` (named with ``prefix``): no ratio is above the fence of the text's group.

    Up to MOST_BROADCAST groups are broadcast. Of more, only those with over a ten thousandth of all texts are, and
    their texts are dealt by number in the join with the others, so that no task takes all texts of one group."""
    names = [n for n, _ in rules.floors]
    r, failed, fine = ratios(prefix), base_failed(rules, prefix), F.lit(True)
    groups, whole = tops.agg(F.count("*"), F.sum(FENCE + "n")).first()
    often = tops if groups <= MOST_BROADCAST else tops.filter(F.col(FENCE + "n") > whole / 10_000)
    alike = lambda t: counted["lang"].eqNullSafe(t[FENCE + "lang"]) & counted["source"].eqNullSafe(t[FENCE + "source"])
    joined, top = counted.join(F.broadcast(often), alike(often), "left"), {n: often[FENCE + n] for n in names}
    if groups > MOST_BROADCAST:
        rest = tops.filter(F.col(FENCE + "n") <= whole / 10_000).select(*(F.col(c).alias("rest" + c) for c in tops.columns), F.lit(0).alias("rest_deal"))
        deal = F.when(often[FENCE + "n"].isNull(), 0).otherwise(1 + F.pmod(F.monotonically_increasing_id(), F.lit(4096)).cast("int"))
        same = counted["lang"].eqNullSafe(rest[f"rest{FENCE}lang"]) & counted["source"].eqNullSafe(rest[f"rest{FENCE}source"]) & (deal == rest["rest_deal"])
        joined, top = joined.join(rest, same, "left"), {n: F.coalesce(often[FENCE + n], rest[f"rest{FENCE}{n}"]) for n in names}
    for n in names:
        fine = fine & F.coalesce(r[n] <= top[n], F.lit(True))
    return joined.select(*(counted[c] for c in counted.columns), failed.alias(prefix + "base_failed"), (~failed & fine).alias(prefix + "kept"))


def judged(docs: DataFrame, rules: Rules = Rules(), prefix: str = "") -> DataFrame:
    """``docs`` with counts, ``base_failed`` and ``kept`` (all named with ``prefix``)."""
    tops = fences(stored(with_counts(docs.select("text", "lang", "source"), prefix).drop("text"), "quality-counts"), rules, prefix)
    return within_fences(with_counts(docs, prefix), tops, rules, prefix)


def quality_rules(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row for each text: doc_id, the counts, base_failed and kept."""
    counted = stored(with_counts(docs.select("doc_id", "text", "lang", "source")).drop("text"), "quality-counts")
    return within_fences(counted, fences(counted, rules), rules).select("doc_id", *COUNTS, "base_failed", "kept")


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    p = free_prefix(docs, "__quality_")
    return judged(docs, rules, p).filter(F.col(p + "kept")).select(*docs.columns)
