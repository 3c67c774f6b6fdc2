"""Error models of alignments: letter by letter along a CIGAR, and by rates for long reads.

Alignments are rows with ``cigar``, ``read`` (the read as it is aligned) and
``ref``, the slice of the target from the alignment's first letter on (see
operators.slices). Batches are expanded with numpy: every letter of an operation
becomes a pair of a target and a read letter. Where a CIGAR refers to letters
that are not there, the alignment ends before them. A batch gives sums by
transition, or one row for each alignment; expanded letters never leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import LOG_EPSILON
from ..store import stored

# fixed values: A, C, G, T are 0 to 3; of the others each stands for the operation on the side that has no letter
DASH, SOFT_CLIP, HARD_CLIP, PAD, SKIP = 4, 5, 6, 7, 8
STATES = 9 * 9
START = STATES  # before the first letter
OPERATIONS = "MIDNSHP=X"
_READS, _REFERS = np.array([c in "MIS=X" for c in OPERATIONS]), np.array([c in "MDN=X" for c in OPERATIONS])
_NO_REF = np.array([0, DASH, 0, 0, SOFT_CLIP, HARD_CLIP, PAD, 0, 0])  # by operation
_NO_READ = np.array([0, 0, DASH, SKIP, 0, HARD_CLIP, PAD, 0, 0])
_CODE = np.zeros(256, np.int64)  # other letters count as A
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i
_DIGIT, _OPERATION = np.full(256, -1, np.int64), np.full(256, -1, np.int64)
_DIGIT[ord("0") : ord("9") + 1] = np.arange(10)
_OPERATION[[ord(_c) for _c in OPERATIONS]] = np.arange(len(OPERATIONS))
MOST_LETTERS = 500_000  # that are expanded at once: each takes some hundred bytes meanwhile


@dataclass
class Letters:
    row: np.ndarray
    op: np.ndarray  # its number in OPERATIONS
    opening: np.ndarray  # whether it belongs to the alignment's first operation
    state: np.ndarray  # 9 * target letter + read letter
    bin: np.ndarray  # of the place in the read

    def before(self) -> np.ndarray:
        same = np.append(False, self.row[1:] == self.row[:-1])
        return np.where(same, np.append(START, self.state[:-1])[: len(same)], START)


def _joined(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, null as empty, and where each begins."""
    flat = pa.array(texts, pa.large_string(), from_pandas=True).fill_null("")
    at = np.frombuffer(flat.buffers()[1], np.int64)[: len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
    return np.frombuffer(flat.buffers()[2] or b"", np.uint8)[: at[-1]], at


def operations(cigars: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number within the row, length and kind of all operations."""
    raw, at = _joined(cigars)
    digit = np.append(_DIGIT[raw], -1)  # at -1 as well
    end = np.flatnonzero(_OPERATION[raw] >= 0)
    row = np.searchsorted(at, end, "right") - 1
    open_ = (end > at[row]) & (digit[end - 1] >= 0)
    end, row = end[open_], row[open_]
    n, place, left = np.zeros(len(end), np.int64), 1, np.arange(len(end))
    at_digit = end - 1
    while len(left):
        n[left] += digit[at_digit[left]] * place
        place *= 10
        at_digit -= 1
        left = left[(at_digit[left] >= at[row[left]]) & (digit[at_digit[left]] >= 0)]
    return row, np.arange(len(row)) - np.searchsorted(row, row), n, _OPERATION[raw[end]]


def letters(cigars: Sequence[str | None], reads: Sequence[str | None], refs: Sequence[str | None], bins: int) -> Letters:
    """All letters of some alignments. A letter that opens an operation lies in the bin of the letter before it.

    What a row has of each operation is found before its letters are made, so none are made that are not there."""
    row, number, n, op = operations(cigars)
    (read, read_at), (ref, ref_at) = _joined(reads), _joined(refs)
    takes, refers = _READS[op], _REFERS[op]
    first = np.searchsorted(row, row)

    def start(uses: np.ndarray) -> np.ndarray:
        """Letters used before each operation, within its alignment."""
        done = np.cumsum(uses * n) - uses * n
        return done - done[first]

    i, j = start(takes), start(refers)
    have = np.minimum(np.where(takes, np.diff(read_at)[row] - i, n), np.where(refers, np.diff(ref_at)[row] - j, n))
    short = np.append(0, np.cumsum(have < n))
    n = np.where(short[:-1] == short[first], np.clip(have, 0, n), 0)  # the first short operation is the last one
    begin = np.cumsum(n) - n
    inner = np.arange(n.sum()) - np.repeat(begin, n)

    def codes(text: np.ndarray, at: np.ndarray, uses: np.ndarray, none: np.ndarray) -> np.ndarray:
        """A letter where the operation uses one, and else what stands for the operation."""
        table = np.append(_CODE[text], none)
        return table[np.repeat(np.where(uses, at, len(text) + op), n) + inner * np.repeat(uses, n)]

    state = 9 * codes(ref, ref_at[row] + j, refers, _NO_REF) + codes(read, read_at[row] + i, takes, _NO_READ)
    own = np.repeat(row, n)
    now = np.zeros(len(own), np.int64)
    if bins > 1 and len(own):
        size = np.maximum(np.diff(read_at), 1)[row]
        now = np.where(np.repeat(takes, n) & (inner > 0), (np.repeat(i, n) + inner) * bins // np.repeat(size, n), 0)
        now = np.minimum(np.maximum.accumulate(now + own * bins) - own * bins, bins - 1)
    return Letters(own, np.repeat(op, n), np.repeat(number == 0, n), state, now)


def _slices(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    size = np.cumsum(pdf["read"].str.len().fillna(0).to_numpy(np.int64) + 64) // MOST_LETTERS
    for _, part in pdf.groupby(size):
        yield part


def _expanded(part: pd.DataFrame, bins: int) -> Letters:
    return letters(*(part[c] for c in ("cigar", "read", "ref")), bins)


# --- letter by letter


def transition_masses(alignments: DataFrame, bins: int = 6) -> DataFrame:
    """(side, bin, prev, cur, mass) over alignments (side, w, cigar, read, ref): the sum of weights w of each transition
    between states, by side (of a pair the left read is 0, the right one 1) and place in the read."""
    wide = STATES + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in _slices(pdf):
                x = _expanded(part, bins)
                sides, side = np.unique(part["side"].to_numpy(np.int64), return_inverse=True)
                w = part["w"].to_numpy(float)
                key = ((side[x.row] * bins + x.bin) * wide + x.before()) * wide + x.state
                if len(sides) * bins * wide * wide > 4 * MOST_LETTERS:
                    keys, number = np.unique(key, return_inverse=True)
                    mass = np.bincount(number, w[x.row], len(keys)) if len(keys) else np.zeros(0)
                else:
                    keys = np.flatnonzero(np.bincount(key))
                    mass = np.bincount(key, w[x.row])[keys]
                rest, cur = np.divmod(keys, wide)
                rest, prev = np.divmod(rest, wide)
                yield pd.DataFrame({"side": sides[rest // bins].astype(np.int32), "bin": (rest % bins).astype(np.int32), "prev": prev.astype(np.int32), "cur": cur.astype(np.int32), "mass": mass})

    rows = alignments.select("side", "w", "cigar", "read", "ref").mapInPandas(run, "side int, bin int, prev int, cur int, mass double")
    return rows.groupBy("side", "bin", "prev", "cur").agg(F.sum("mass").alias("mass"))


def log_rates(masses: DataFrame, bins: int = 6, alpha: float = 1.0, sides: int = 2) -> np.ndarray:
    """Logarithms of transition rates, [side, bin, prev, cur], of masses and ``alpha`` more for each.

    A table of a fixed size: sides, bins, and 82 states each way."""
    table = np.full((sides, bins, STATES + 1, STATES + 1), alpha)
    for r in masses.toLocalIterator():
        table[r.side, r.bin, r.prev, r.cur] += r.mass
    return np.log(table / table.sum(axis=3, keepdims=True))


def log_error(alignments: DataFrame, rates: np.ndarray, kept: list[str]) -> DataFrame:
    """``kept`` columns and log_err: the logarithm of an alignment's transitions, less that of as many matches of A.

    An alignment without CIGAR has LOG_EPSILON."""
    table = alignments.sparkSession.sparkContext.broadcast((rates - rates[:, :, :1, :1]).ravel())
    bins = rates.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in _slices(pdf):
                x = _expanded(part, bins)
                side = part["side"].to_numpy(np.int64)
                at = ((side[x.row] * bins + x.bin) * (STATES + 1) + x.before()) * (STATES + 1) + x.state
                found = np.bincount(x.row, table.value[at], len(part)) if len(x.row) else np.zeros(len(part))
                out = part[kept].copy()
                out["log_err"] = np.where(part["cigar"].fillna("").str.contains("[0-9]"), found, LOG_EPSILON)
                yield out

    schema = T.StructType([*(alignments.schema[c] for c in kept), T.StructField("log_err", T.DoubleType())])
    return alignments.select(*dict.fromkeys([*kept, "side", "cigar", "read", "ref"])).mapInPandas(run, schema)


# --- long reads

COUNTS = ["matches", "mismatches", "insertions", "deletions", "soft", "hard", "front", "back"]
_KIND = np.array([0, 2, 3, 6, 4, 5, 6, 0, 1])  # of each operation, its number in COUNTS; a mismatch of M is one more, 6 is none


def error_counts(alignments: DataFrame, kept: list[str]) -> DataFrame:
    """``kept`` columns, size (of the read as it is stored) and counts of an alignment's letters: matches, mismatches,
    insertions, deletions, soft and hard clips, and clips at the front and behind it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in _slices(pdf):
                x = _expanded(part, 1)
                kind = _KIND[x.op] + ((x.op == 0) & (x.state // 9 != x.state % 9))
                found = np.bincount(x.row * 7 + kind, minlength=len(part) * 7).reshape(-1, 7)
                clip = (kind == 4) | (kind == 5)
                front = np.bincount(x.row[clip & x.opening], minlength=len(part))
                out = part[kept].copy()
                out["size"] = part["read"].str.len().fillna(0).astype(np.int64)
                for name, counts in zip(COUNTS, (*found.T[:6], front, found[:, 4] + found[:, 5] - front), strict=True):
                    out[name] = counts.astype(np.int64)
                yield out

    more = [T.StructField(c, T.LongType()) for c in ("size", *COUNTS)]
    return alignments.select(*dict.fromkeys([*kept, "cigar", "read", "ref"])).mapInPandas(run, T.StructType([*(alignments.schema[c] for c in kept), *more]))


def length_bin(length: Column, bases: int = 100, longest: int = 50_000) -> Column:
    return F.least(F.floor(length / bases), F.lit(longest // bases)).cast("int")


def _errors() -> Column:
    return F.col("mismatches") + F.col("insertions") + F.col("deletions")


def long_read_rates(counted: DataFrame, bases: int = 100) -> DataFrame:
    """(kind, bin, mass, mean) of counted alignments with a weight w: the mean share of errors by length of the aligned
    part (kind error), and the mean number of letters clipped before and behind it by length of the read (front, back)."""
    aligned, whole = F.col("size") - F.col("soft"), F.col("size") + F.col("hard")
    shares = {"error": (aligned, _errors() / F.nullif(aligned, F.lit(0))), "front": (F.col("size"), F.col("front") / F.nullif(whole, F.lit(0))), "back": (F.col("size"), F.col("back") / F.nullif(whole, F.lit(0)))}
    fine = counted.filter(" and ".join(["size > soft", "w > 0"])).filter(_errors() <= aligned)
    one = [F.struct(F.lit(k).alias("kind"), length_bin(n, bases).alias("bin"), (share if k == "error" else share * (length_bin(n, bases) + 1) * bases).alias("x")) for k, (n, share) in shares.items()]
    rows = fine.select("w", F.explode(F.array(*one)).alias("r"))
    return rows.groupBy("r.kind", "r.bin").agg(F.sum("w").alias("mass"), (F.sum(F.col("w") * F.col("r.x")) / F.sum("w")).alias("mean"))


def binomial_cdf(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(X <= k) of binomial distributions, by the continued fraction of the incomplete beta function."""
    k, n, p = np.broadcast_arrays(np.asarray(k, np.int64), np.asarray(n, np.int64), np.asarray(p, float))
    out = np.where(k < 0, 0.0, 1.0)
    at = np.flatnonzero((k >= 0) & (k < n) & (p > 0))
    out[(k >= 0) & (k < n) & (p >= 1)] = 0.0
    at = at[p[at] < 1]
    if not len(at):
        return out
    fact = np.append(0.0, np.cumsum(np.log(np.arange(1, int(n[at].max()) + 1))))
    a, b, x = (n - k)[at].astype(float), (k + 1)[at].astype(float), 1 - p[at]
    swap = x > (a + 1) / (a + b + 2)  # the side on which the fraction converges fast
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    front = np.exp(fact[n[at]] - fact[(a - 1).astype(int)] - fact[(b - 1).astype(int)] + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    c, d = np.ones(len(at)), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 2000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            h *= d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    value = front * h
    out[at] = np.clip(np.where(swap, 1 - value, value), 0, 1)
    return out


def binomial_median(n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The smallest k with P(X <= k) of a half and more; it lies within one of n p."""
    k = np.maximum(np.floor(n * p).astype(np.int64) - 1, 0)
    for _ in range(3):
        k = np.where(binomial_cdf(k, n, p) < 0.5, k + 1, k)
    return k


def long_read_log(counted: DataFrame, rates: DataFrame, bases: int = 100, least: float = 1e-10, upper: str = "tail") -> DataFrame:
    """``counted`` alignments with log_err: the chance of an error count as far from the median or further, on both sides,
    and of more clipped letters than the mean has, before and behind. Chances below ``least`` count as none.

    upper: "tail" adds the chance of more errors than the upper count, "below" that of no more than it, a sum that is at
    least about a half and so never excludes an alignment for its errors. An alignment with chimeric true, or without any aligned letter, has none; where a bin has no rate the factor is 1.
    rates have a row for each kind and bin, fewer than 1,503."""
    rates = stored(rates, "long-read-rates")  # read once for each kind
    rate = lambda kind, n, name: rates.filter(F.col("kind") == kind).select(F.col("bin").alias(n), F.col("mean").alias(name))
    aligned = F.col("size") - F.col("soft") - F.col("hard")
    rows = counted.withColumns({"aligned": aligned, "__e": length_bin(aligned, bases), "__c": length_bin(F.col("size"), bases)})
    for kind, key in (("error", "__e"), ("front", "__c"), ("back", "__c")):
        rows = rows.join(F.broadcast(rate(kind, key, f"__{kind}")), key, "left")

    @F.pandas_udf("double")
    def tails(errors: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
        e, n, p = errors.to_numpy(np.int64), np.maximum(n.to_numpy(np.int64), 0), p.to_numpy(float)
        p = np.where(np.isnan(p), 0.0, p)
        middle = binomial_median(n, p)
        off = np.abs(middle - e)
        high = binomial_cdf(np.minimum(middle + off, n), n, p)
        return pd.Series(binomial_cdf(np.maximum(middle - off, 0), n, p) + (1 - high if upper == "tail" else high))

    def log_of(chance: Column) -> Column:
        return F.when(chance < least, float("-inf")).otherwise(F.log(chance))

    def clipped(kind: str) -> Column:
        mean = F.col(f"__{kind}")
        more = F.col(kind) - F.round(mean)
        return F.when(mean.isNull() | (mean <= 0) | (more <= 0), 0.0).otherwise(log_of(F.pow(mean / (mean + 1), more)))

    known = F.col("__error").isNotNull() & F.col("__front").isNotNull() & F.col("__back").isNotNull()
    error = F.when(known, log_of(tails(_errors(), F.col("aligned"), F.coalesce("__error", F.lit(0.0))))).otherwise(0.0)
    none = (F.col("aligned") <= 0) | (F.coalesce("chimeric", F.lit(False)) if "chimeric" in counted.columns else F.lit(False))
    value = F.when(none, float("-inf")).otherwise(error + clipped("front") + clipped("back"))
    return rows.withColumn("log_err", value).select(*counted.columns, "log_err")
