"""Encoding and decoding with a word BPE vocabulary (operator 3).

A text is cut into words by Spark tasks; words not met before are encoded
together: the symbols of all of them lie in one flat array, and in each round
the pair of lowest rank of every word is found by binary search over the sorted
keys of the vocabulary's pairs and merged, until no word has a pair left. The
number of rounds follows the longest word's merges, not the number of words.

Decoding starts from the ids alone: tokens lie in one byte array, and those of
all ids of a batch are gathered in one step.

Edge cases: a null text counts as empty and has no ids; texts of any length are
encoded whole; special tokens in a text are recognised, as the vocabulary says.
Repeated rows are encoded one by one; of a word's equal pairs the leftmost goes
first. An empty table gives an empty one. Only doc_id and text are read, so
further columns may have any name.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .wordscan import slices

#: Most bytes of chunks between white space, with their ids, that a worker remembers; beyond it forgets all and goes on.
MOST_CACHED = 96 << 20
_NONE = np.iinfo(np.int64).max
#: Python's split() also cuts at U+001C to U+001F, which Unicode doesn't count as white space.
_ODD = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 as it is, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    _made: dict[str, "WordBpe"] = {}

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {v: k for k, v in {**vocab, **self.special}.items()}
        self.word = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + end] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.arange(len(pairs), dtype=np.int64)[order]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        self.tokens, self.numbers = pieces_of(self.token), pieces_of({i: str(i) for i in self.token})
        self.seen: dict[str, bytes] = {}
        self.held = 0

    @classmethod
    def load(cls, path: str) -> "WordBpe":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and where each word begins in it."""
        raw = [w.encode() for w in words]
        size = np.array([len(w) for w in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        word = np.repeat(np.arange(len(raw)), size)
        symbols = self.inner[data]
        last = np.cumsum(size) - 1
        symbols[last] = self.final[data[last]]
        done_word, done_symbols = [], []
        while len(symbols):
            same = np.append(word[1:] == word[:-1], False)
            rank = np.full(len(symbols), _NONE)
            at = np.flatnonzero(same)
            rank[at] = self.pair_ranks(symbols[at], symbols[at + 1])
            begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lowest = np.minimum.reduceat(rank, begin)
            count = np.diff(np.append(begin, len(symbols)))
            over = np.repeat(lowest == _NONE, count)
            if over.any():
                done_word.append(word[over])
                done_symbols.append(symbols[over])
            hit = (rank == np.repeat(lowest, count)) & ~over
            at = np.flatnonzero(hit)
            if len(at) > 1:  # of overlapping hits (aaa) every second one, from the left
                fresh = np.append(True, np.diff(at) > 1)
                run = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[run % 2 == 0]
            symbols[at] = self.merged[rank[at]]
            stay = ~over
            stay[at + 1] = False
            symbols, word = symbols[stay], word[stay]
        if not done_word:
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        word, symbols = np.concatenate(done_word), np.concatenate(done_symbols)
        order = np.argsort(word, kind="stable")
        return symbols[order], np.searchsorted(word[order], np.arange(len(words) + 1))

    def chunks(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case goes letter by letter
        text = text.lower()
        return [c for c in _SPACE.split(text) if c] if _ODD.search(text) else text.split()

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text begins in it."""
        seen = self.seen
        if self.held > MOST_CACHED:
            seen.clear()
            self.held = 0
        for s, i in self.special.items():
            seen["\n" + s] = np.array([i], "<i4").tobytes()
        cut, met = [], set()
        for t in texts:
            own: list[str] = []
            for part in self.cut.split(t) if any([s in t for s in self.special]) else (t,):
                own += ["\n" + part] if part in self.special else self.chunks(part)
            met.update(own)
            cut.append(own)
        todo = [(c, self.word.findall(c)) for c in met.difference(seen)]
        words = list(dict.fromkeys(w for _, ws in todo for w in ws))
        number = {w: i for i, w in enumerate(words)}
        ids, first = self.merge_words(words)
        raw, first = ids.astype("<i4").tobytes(), (first * 4).tolist()
        for c, ws in todo:
            own = b"".join([raw[first[i] : first[i + 1]] for i in map(number.__getitem__, ws)])
            seen[c] = own
            self.held += len(c) + len(own) + 200
        flat = [b"".join([seen[c] for c in own]) for own in cut]
        return np.frombuffer(b"".join(flat), "<i4"), np.cumsum([0, *map(len, flat)]) // 4

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode_batch(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """The text of each run of ids, in UTF-8: the vocabulary names no decoder, so tokens are joined by spaces.
        Ids that it doesn't have leave nothing."""
        return joined(self.tokens, ids, first)

    def decode(self, ids: list[int]) -> str:
        return self.decode_batch(np.array(ids, np.int64), np.array([0, len(ids)]))[0].decode()

    def decimals(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """Each run of ids as decimal numbers with one space between."""
        return joined(self.numbers, ids, first)


def pieces_of(entries: dict[int, str]) -> tuple[np.ndarray, np.ndarray]:
    """Entries by number, each with a space behind it, as one byte array; where each begins. The last one is empty."""
    raw = [(entries[i] + " ").encode() if i in entries else b"" for i in range(max(entries) + 1)] + [b""]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def joined(table: tuple[np.ndarray, np.ndarray], ids: np.ndarray, first: np.ndarray) -> list[bytes]:
    """The entries of each run of ids, gathered from the table in one step, without the last space."""
    data, begin = table
    known = np.where((ids >= 0) & (ids < len(begin) - 1), ids, len(begin) - 2)
    start = begin[known]
    size = begin[known + 1] - start
    end = np.cumsum(size)
    out = data[np.arange(end[-1] if len(end) else 0) + np.repeat(start - end + size, size)].tobytes()
    at = np.append(0, end)[first].tolist()
    return [out[a : b - 1] if b > a else b"" for a, b in zip(at[:-1], at[1:], strict=True)]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every text."""
    docs = docs.select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = WordBpe.load(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, first = codec.encode_batch(pc.fill_null(part.column("text"), "").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids))], names=schema.names)

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of ids; null ids give a null text."""
    schema = T.StructType([encoded.schema["doc_id"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = WordBpe.load(path)
        for batch in batches:
            runs = batch.column("ids")
            first = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False)))
            ids = pc.fill_null(runs.flatten(), -1).to_numpy(zero_copy_only=False)
            text = pa.array(codec.decode_batch(ids, first), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.if_else(runs.is_valid(), text, None)], names=schema.names)

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)


def encode_decode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text: its ids, and the text that these ids decode to."""
    docs = docs.select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    sha = lambda runs: pa.array([hashlib.sha256(x).hexdigest() for x in runs], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = WordBpe.load(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, first = codec.encode_batch(pc.fill_null(part.column("text"), "").to_pylist())
                arrays = [part.column("doc_id"), pa.array(np.diff(first), pa.int64()), sha(codec.decimals(ids, first)), sha(codec.decode_batch(ids, first))]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.mapInArrow(run, schema)
