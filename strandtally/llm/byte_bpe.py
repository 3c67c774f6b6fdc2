"""Encoding and decoding with a byte-level BPE vocabulary of ranks (operator 12).

Each match of the vocabulary's pattern is merged by itself. All matches of a
batch that the worker has not met lie in one byte array, with a wall between
them; tokens are a linked list over it. A queue holds, for every merge rank, the
places where that pair begins, and a bitmap of three levels says which ranks
have any: finding the first set bit on each level gives the next rank, whatever
their number. A merge changes at most two pairs; entries that no longer hold are
skipped when their turn comes. Of a rank's places the leftmost goes first, and a
merge may bring up a lower rank than its own, which is then next. So a match of
n bytes takes in the order of n steps and not n squared, however long it is.

Decoding gathers token bytes by the ids from one byte array.

Long texts are cut where a visible character is followed by white space, which
no match crosses, and go through part by part, so memory follows the longest
stretch without such a place (some 60 bytes for each of its bytes).

Edge cases: a null text counts as empty and has no ids; a match that is a token
as a whole is that token; repeated rows are encoded one by one; a null
identifier is carried along; an empty table gives an empty one. Only doc_id and
text are read, so further columns may have any name.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .wordscan import slices

#: Most bytes of matches, with their ids, that a worker remembers; beyond it forgets all and goes on.
MOST_CACHED = 96 << 20
#: Characters of a long text that go through at once, if there is a place to cut.
PART = 1 << 20
_WALL = -1


class RankQueue:
    """Places by rank; the lowest rank with any is found by first set bits, word by word from the top.

    ``rank`` are the ranks of the places to begin with (negative: none); they stay in one sorted array. Places that come
    later lie in a heap for their rank, so that of both the leftmost is taken."""

    def __init__(self, rank: np.ndarray) -> None:
        at = np.flatnonzero(rank >= 0)
        at = at[np.argsort(rank[at], kind="stable")]
        ranks, first = np.unique(rank[at], return_index=True)
        self.places = array("q", at.astype(np.int64).tobytes())
        self.next = dict(zip(ranks.tolist(), first.tolist(), strict=True))
        self.stop = dict(zip(ranks.tolist(), np.append(first, len(at))[1:].tolist(), strict=True))
        self.late: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}
        self.mid: dict[int, int] = {}
        self.top = 0
        for r in ranks.tolist():
            self.mark(r)

    def mark(self, rank: int) -> None:
        a, b = rank >> 6, rank >> 12
        self.low[a] = self.low.get(a, 0) | 1 << (rank & 63)
        self.mid[b] = self.mid.get(b, 0) | 1 << (a & 63)
        self.top |= 1 << b

    def clear(self, rank: int) -> None:
        a, b = rank >> 6, rank >> 12
        self.low[a] &= ~(1 << (rank & 63))
        if not self.low[a]:
            self.mid[b] &= ~(1 << (a & 63))
            if not self.mid[b]:
                self.top &= ~(1 << b)

    def lowest(self) -> int:
        """The lowest rank that has places, -1 if none has."""
        if not self.top:
            return -1
        b = (self.top & -self.top).bit_length() - 1
        word = self.mid[b]
        a = b << 6 | (word & -word).bit_length() - 1
        word = self.low[a]
        return a << 6 | (word & -word).bit_length() - 1

    def taken(self, rank: int) -> Iterator[int]:
        """The places of a rank that has some, from the left, for as long as the caller takes them; what comes meanwhile
        takes its turn. The rank's bit goes with its last place."""
        places, heap = self.places, self.late.get(rank) or self.late.setdefault(rank, [])
        at, stop = self.next.get(rank, 0), self.stop.get(rank, 0)
        try:
            while heap or at < stop:
                if heap and (at == stop or heap[0] < places[at]):
                    place = heappop(heap)
                else:
                    place = places[at]
                    at += 1
                yield place
        finally:
            self.next[rank] = at
            if at == stop and not heap:
                self.clear(rank)


class ByteBpe:
    """Ids of a vocabulary of byte ranks (a file of base64 tokens and numbers) behind a pattern."""

    _made: dict[tuple[str, str], "ByteBpe"] = {}

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:  # a vocabulary lies on every machine, as its library does
            raw = f.read()
        self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in raw.splitlines() if line)}
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"{path} has no token for the bytes {missing[:5]}")
        self.match = regex.compile(pattern)
        self.odd, self.stand_in = stand_ins()
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs = np.full(1 << 16, -1, np.int64)
        tokens = [b""] * (max(self.ranks.values()) + 2)
        for t, r in self.ranks.items():
            tokens[r] = t
            if len(t) == 2:
                self.pairs[t[0] << 8 | t[1]] = r
        self.bytes, self.begin = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum([0, *map(len, tokens)])
        self.seen: dict[str, bytes] = {}
        self.held = 0

    @classmethod
    def load(cls, path: str, pattern: str) -> "ByteBpe":
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(path, pattern)
        return cls._made[path, pattern]

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each word (none of them empty), all merged in one queue."""
        data = b"\0" + b"\0".join(words) + b"\0"
        letters = np.frombuffer(data, np.uint8)
        n = len(data)
        walls = np.cumsum([0, *(len(w) + 1 for w in words)])
        size_ = np.ones(n, np.int32)
        size_[walls] = 0  # no token begins at a wall
        pair_ = np.full(n, _WALL, np.int64)
        pair_[:-1] = self.pairs[letters[:-1].astype(np.int64) << 8 | letters[1:]]
        pair_[walls] = _WALL
        pair_[walls[1:] - 1] = _WALL
        queue = RankQueue(pair_)
        size, pair = array("i", size_.tobytes()), array("q", pair_.tobytes())
        before = array("q", np.arange(-1, n - 1, dtype=np.int64).tobytes())
        token = array("q", self.single[letters].tobytes())
        get, late, mark = self.ranks.get, queue.late, queue.mark
        while (rank := queue.lowest()) >= 0:
            for i in queue.taken(rank):
                if pair[i] != rank:
                    continue  # merged away, or another pair by now
                j = i + size[i]
                k = j + size[j]
                h, pair[j], size[j], size[i], token[i] = before[i], _WALL, 0, k - i, rank
                lowest = rank
                if size[k]:
                    before[k] = i
                    right = get(data[i : k + size[k]], _WALL)
                else:
                    right = _WALL
                pair[i] = right
                for place, new in ((i, right), (h, get(data[h:k], _WALL))) if size[h] else ((i, right),):
                    pair[place] = new
                    if new >= 0:
                        heap = late.get(new)
                        if heap:
                            heappush(heap, place)
                        else:
                            late[new] = [place]
                            mark(new)
                        if new < lowest:
                            lowest = new
                if lowest < rank:
                    break
        live = np.frombuffer(size, np.int32) > 0
        ids = np.frombuffer(token, np.int64)[live].astype("<u4").tobytes()
        at = (4 * np.append(0, np.cumsum(live)))[walls].tolist()
        return [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def matches(self, text: str) -> list[str]:
        if self.odd is not None and not text.isascii() and self.odd.search(text):
            return [text[slice(*m.span())] for m in self.match.finditer(text.translate(self.stand_in))]
        return self.match.findall(text)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, all matches that are new merged together."""
        seen = self.seen
        if self.held > MOST_CACHED:
            seen.clear()
            self.held = 0
        cut = [self.matches(t) for t in texts]
        todo, words = [], []
        for m in set().union(*cut).difference(seen):
            raw = m.encode()
            whole = self.ranks.get(raw)
            if whole is None:
                todo.append(m)
                words.append(raw)
            else:
                seen[m] = whole.to_bytes(4, "little")
                self.held += len(raw) + 200
        for m, ids in zip(todo, self.merge(words) if words else [], strict=True):
            seen[m] = ids
            self.held += len(m) + len(ids) + 200
        return [b"".join([seen[m] for m in own]) for own in cut]

    def parts(self, text: str) -> Iterator[str]:
        """The text in parts that can be encoded one by one."""
        at = 0
        while len(text) - at > PART:
            cut = _CUT.search(text, at + PART)
            if not cut:
                break
            yield text[at : cut.start() + 1]
            at = cut.start() + 1
        yield text[at:] if at else text

    def encode_texts(self, texts: pa.Array) -> Iterator[Iterator[bytes]]:
        """Ids of each text in the order of its parts; null counts as empty. Texts of one part go through together."""
        whole = pc.fill_null(texts, "").to_pylist()
        short = iter(self.encode_batch([t for t in whole if len(t) <= PART]))
        for t in whole:
            yield iter([next(short)]) if len(t) <= PART else (self.encode_batch([part])[0] for part in self.parts(t))

    def encode(self, text: str) -> list[int]:
        return [i for own in self.encode_texts(pa.array([text])) for ids in own for i in np.frombuffer(ids, "<u4").tolist()]

    def decode(self, ids: bytes | list[int]) -> bytes:
        """The bytes of a run of ids, gathered in one step; ids that the vocabulary doesn't have leave nothing."""
        number = np.frombuffer(ids, "<u4").astype(np.int64) if isinstance(ids, bytes) else np.array(ids, np.int64)
        number = np.where((number >= 0) & (number < len(self.begin) - 2), number, len(self.begin) - 2)
        start = self.begin[number]
        size = self.begin[number + 1] - start
        end = np.cumsum(size)
        return self.bytes[np.arange(end[-1] if len(end) else 0) + np.repeat(start - end + size, size)].tobytes()


#: A visible character before white space: no match of a pattern of this kind goes on from the one to the other.
_CUT = re.compile(r"\S(?=[ \n])")


@functools.cache
def stand_ins() -> tuple[regex.Pattern | None, dict[int, str]]:
    """Characters that the library counts as letters or numbers and our expressions don't, or the other way round, as
    their Unicode versions differ: an expression that finds them, and for each a character that both see alike."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    ranks = {bytes([b]): b for b in range(256)}
    theirs, ours = {}, {}
    for name in (r"\p{L}", r"\p{N}"):
        found = bytes(tiktoken.Encoding("class", pat_str=name, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(every))
        theirs[name], ours[name] = set(found.decode()), set(regex.findall(name, every))
    odd = (theirs[r"\p{L}"] ^ ours[r"\p{L}"]) | (theirs[r"\p{N}"] ^ ours[r"\p{N}"])
    if not odd:
        return None, {}
    code = np.array(sorted(map(ord, odd)))
    new = np.flatnonzero(np.append(True, np.diff(code) > 1))
    spans = "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in zip(code[new], code[np.append(new[1:], len(code)) - 1], strict=True))
    return re.compile(f"[{spans}]"), {ord(c): "é" if c in theirs[r"\p{L}"] else "²" if c in theirs[r"\p{N}"] else "¤" for c in odd}


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every text."""
    docs = docs.select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ByteBpe.load(path, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [np.frombuffer(b"".join(own), "<i4") for own in codec.encode_texts(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=schema.names)

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and bytes of every row of ids; null ids give null, and a null among them nothing."""
    schema = T.StructType([encoded.schema["doc_id"], T.StructField("bytes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ByteBpe.load(path, pattern)
        for batch in batches:
            raw = [None if own is None else codec.decode([-1 if i is None else i for i in own]) for own in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], names=schema.names)

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)


def encode_decode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text: its ids, and the bytes that these ids decode to."""
    docs = docs.select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ByteBpe.load(path, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                count, digests = [], ([], [])
                for own in codec.encode_texts(part.column("text")):
                    n, ids_sha, decoded_sha = 0, hashlib.sha256(), hashlib.sha256()
                    for ids in own:
                        n += len(ids) // 4
                        ids_sha.update(ids)
                        decoded_sha.update(codec.decode(ids))
                    count.append(n)
                    for out, sha in zip(digests, (ids_sha, decoded_sha), strict=True):
                        out.append(sha.hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(count, pa.int64()), *(pa.array(d, pa.string()) for d in digests)], names=schema.names)

    return docs.mapInArrow(run, schema)
