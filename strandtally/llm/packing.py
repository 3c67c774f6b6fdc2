"""Best-fit packing of token sequences (operator 7).

Texts are tokenised within their tasks, an end id is added, and only those over
the capacity are cut: all pieces but the first are full, so each of them fills a
sequence alone. Pieces are packed by bounded-space online best fit: each task
takes its pieces longest first and holds at most ``open_bins`` bins in a bitset
keyed by free space; a piece goes where least space remains, and when too many
bins are open the fullest closes. No two bins that are at most half full can be
open at once, so each task leaves one such bin at most; these few are packed
once more across tasks.

Edge cases: a null text counts as empty and is the end id alone; repeated rows
are packed as rows of their own; a null identifier is carried along.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .shared import stored
from .word_bpe import byte_letters
from .wordscan import slices

CAPACITY = 2048
#: Pre-tokeniser of the byte-level vocabulary: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space of this length is left to the tokenizers library: tiktoken's expression fails at some length beyond.
_LONG_SPACE = re.compile(r"\s{1000}")


class ByteBpe:
    """Ids of a byte-level BPE vocabulary.

    Where the vocabulary numbers its tokens in the order of its merges, a text's
    ids come from tiktoken in one call, which takes less than looking up its
    words among those met before. Other vocabularies, texts with special tokens
    and very long white space take the plain way."""

    _made: dict[str, "ByteBpe"] = {}

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        vocab, letters = spec["model"]["vocab"], {c: b for b, c in enumerate(byte_letters())}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        ordered = spec["normalizer"] is None and all(vocab[a + b] == 256 + i for i, (a, b) in enumerate(pairs))
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ordered else None

    @classmethod
    def load(cls, path: str) -> "ByteBpe":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def plain(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out = []
        for t in texts:
            plain = self.fast is None or any([s in t for s in self.special]) or _LONG_SPACE.search(t)
            out.append(self.plain(t) if plain else np.array(self.fast.encode_ordinary(t), "<u4").tobytes())
        return out


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a text's pieces; all but the first are full."""
    first = total % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, total, capacity))]


_PIECES = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """The pieces of every text: doc_id, piece, start, length, ids_crc32, and ids if asked for."""
    docs = docs.select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, t) for n, t in _PIECES), *([T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, end = ByteBpe.load(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "text"):
                row, cols, ids = [], ([], [], [], []), []
                for i, got in enumerate(codec.encode_batch(pc.fill_null(part.column("text"), "").to_pylist())):
                    got += end
                    for k, (start, length) in enumerate(cut(len(got) // 4, capacity)):
                        own = got[4 * start : 4 * (start + length)]
                        row.append(i)
                        for c, v in zip(cols, (k, start, length, zlib.crc32(own)), strict=True):
                            c.append(v)
                        if with_ids:
                            ids.append(np.frombuffer(own, "<i4"))
                arrays = [part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])]
                if with_ids:
                    arrays.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.mapInArrow(run, schema)


class OpenBins:
    """At most ``most`` open bins, by free space."""

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.most, self.count, self.made = capacity, most, 0, 0
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0

    def place(self, length: int) -> tuple[int, int]:
        """The bin that a piece goes to, and its place there."""
        fits = self.bits >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            own = self.free[space]
            bin_id = own.pop()
            if not own:
                self.bits ^= 1 << space
            self.count -= 1
        else:
            space, bin_id = self.capacity, self.made
            self.made += 1
        left = space - length
        if left:
            self.free[left].append(bin_id)
            self.bits |= 1 << left
            self.count += 1
            if self.count > self.most:  # the fullest closes
                fullest = (self.bits & -self.bits).bit_length() - 1
                self.free[fullest].pop(0)
                if not self.free[fullest]:
                    self.bits ^= 1 << fullest
                self.count -= 1
        return bin_id, self.capacity - space


def _packer(capacity: int, most: int, length: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = OpenBins(capacity, most), TaskContext.get().partitionId() << 32
        for batch in batches:
            got = [bins.place(n) for n in batch.column(batch.schema.get_field_index(length)).to_pylist()]
            new = [pa.array([base + b for b, _ in got], pa.int64()), pa.array([o for _, o in got], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "bin", "at"])

    return run


def pack(parts: DataFrame, capacity: int = CAPACITY, open_bins: int = 4096, rows_per_task: int = 65_536) -> DataFrame:
    """``parts`` (a table that can be read again, with a column length) with sequence_id and offset."""
    place = [T.StructField("bin", T.LongType()), T.StructField("at", T.LongType())]
    tasks = max(1, -(-parts.count() // rows_per_task))
    keys = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in parts.columns]
    dealt = parts.repartition(tasks, *keys).sortWithinPartitions(F.col("length").desc(), *keys)
    placed = stored(dealt.mapInArrow(_packer(capacity, open_bins, "length"), T.StructType([*parts.schema.fields, *place])), "packed")
    light = placed.groupBy(F.col("bin").alias("light")).agg(F.sum("length").alias("used")).filter(F.col("used") <= capacity // 2)
    again = light.coalesce(1).sortWithinPartitions(F.col("used").desc(), "light")  # one bin for each task at most
    again = again.mapInArrow(_packer(capacity, open_bins, "used"), T.StructType([*light.schema.fields, *place]))
    moved = again.select("light", F.col("bin").alias("to"), F.col("at").alias("shift"))
    return placed.join(F.broadcast(moved), placed["bin"] == moved["light"], "left").select(
        *parts.columns, F.coalesce(-1 - F.col("to"), F.col("bin")).alias("sequence_id"), (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset")
    )


def best_fit_packing(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids.

    Ids stay out of the packing and come back to the placed pieces by a mark."""
    parts = stored(pieces(docs, path, capacity, end_id, with_ids=True).withColumn("mark", F.monotonically_increasing_id()), "pieces")
    placed = pack(parts.drop("ids"), capacity)
    return placed.join(parts.select("mark", "ids"), "mark").drop("mark").select("doc_id", *(n for n, _ in _PIECES), "sequence_id", "offset", "ids")
