"""K-mers as numbers of two bits a letter, made batch by batch with numpy from Arrow text columns.

A=0, C=1, G=2, T=3, the first letter in the highest bits, so that numbers order as the k-mers do. Windows with any other
letter give none. A null or short sequence has no k-mers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONGEST = 31  # letters that a long holds; odd, so that no k-mer is its own reverse complement
COUNTED = 1 << 20  # letters that are sorted at a time: each takes some hundred bytes meanwhile
_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i


def check_k(k: int) -> None:
    if not 1 <= k <= LONGEST or k % 2 == 0:
        raise ValueError(f"k must be odd and at most {LONGEST}, not {k}")


def parts(batch: pa.RecordBatch, column: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Row ranges of about that much text; a longer text comes alone."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    if len(size):
        cuts = np.flatnonzero(np.diff(np.cumsum(size, dtype=np.int64) // most_bytes)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(size)], strict=True):
            yield batch.slice(a, b - a)


def codes(texts: pa.Array, k: int, both_strands: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pos, code) of all k-mers; both_strands: the smaller of a k-mer and its reverse complement."""
    row, at, code, other = strand_codes(texts, k, both_strands)
    return row, at, np.minimum(code, other) if both_strands else code


def strand_codes(texts: pa.Array, k: int, both_strands: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, pos, code, code of the reverse complement) of all k-mers."""
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = _CODE[np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    n = len(data) - k + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    odd = np.concatenate([[0], np.cumsum(data == 4)])
    at = np.flatnonzero((offsets[row + 1] - np.arange(n) >= k) & (odd[k:] == odd[:n]))
    code, other = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for j in range(k):
        letter = data[at + j].astype(np.int64)
        code = code << 2 | letter
        if both_strands:
            other |= (3 - letter) << 2 * j
    row = row[at]
    return row, at - offsets[row], code, other


def kmer_places(sequences: DataFrame, name: str, k: int, place: str = "pos") -> DataFrame:
    """(kmer, name, place) of every k-mer of the column seq; ``name`` is the column that identifies a sequence."""
    check_k(k)
    schema = T.StructType([T.StructField("kmer", T.LongType()), sequences.schema[name], T.StructField(place, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "seq"):
                row, at, code = codes(part.column("seq"), k)
                yield pa.RecordBatch.from_arrays([pa.array(code), part.column(name).take(pa.array(row)), pa.array(at.astype(np.int32))], names=schema.names)

    return sequences.select(name, "seq").mapInArrow(run, schema)


def stranded_places(sequences: DataFrame, name: str, k: int, place: str = "pos") -> DataFrame:
    """(kmer, name, place, fwd, length): the smaller of each k-mer and its reverse complement, whether it is the k-mer
    itself, and the length of its sequence."""
    check_k(k)
    schema = T.StructType([T.StructField("kmer", T.LongType()), sequences.schema[name], T.StructField(place, T.IntegerType()), T.StructField("fwd", T.BooleanType()), T.StructField("length", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "seq"):
                row, at, code, other = strand_codes(part.column("seq"), k)
                size = pc.fill_null(pc.utf8_length(part.column("seq")), 0).to_numpy(zero_copy_only=False)
                arrays = [pa.array(np.minimum(code, other)), part.column(name).take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(code < other), pa.array(size[row].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return sequences.select(name, "seq").mapInArrow(run, schema)


def kmer_counts(sequences: DataFrame, k: int, both_strands: bool = True) -> DataFrame:
    """(kmer, n, targets): how often each k-mer occurs, and in how many rows. Each batch is summed before the shuffle.

    Of both strands, k must be odd; on one strand it may be even."""
    check_k(k if both_strands else k | 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "seq", COUNTED):
                row, _, code = codes(part.column("seq"), k, both_strands)
                order = np.lexsort((row, code))
                row, code = row[order], code[order]
                new = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
                fresh = np.append(True, (code[1:] != code[:-1]) | (row[1:] != row[:-1])).astype(np.int64) if len(code) else np.zeros(0, np.int64)
                n = np.diff(np.append(new, len(code)))
                yield pa.RecordBatch.from_arrays([pa.array(code[new]), pa.array(n), pa.array(np.add.reduceat(fresh, new) if len(new) else fresh)], names=["kmer", "n", "targets"])

    return sequences.select("seq").mapInArrow(run, "kmer long, n long, targets long").groupBy("kmer").agg(F.sum("n").alias("n"), F.sum("targets").alias("targets"))
