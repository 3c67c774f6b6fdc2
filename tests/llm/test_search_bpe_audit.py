"""Ranked search, byte-level BPE and the filter audit against plain versions and the tiktoken library; edge cases."""

import base64
import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from strandtally.llm import byte_bpe, filter_audit, lexical_search
from strandtally.llm.lexical_search import SearchRules

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
CLASH = ["mark", "n", "term", "tf", "impact", "qid", "score", "part", "mask", "digest", "first", "copy", "key", "named", "step", "ids", "level", "good", "rank"]
DOCS = "doc_id long, text string, source string"


def clashing(df):
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH})


# --- search


def plain_search(docs, items, best=10):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    bags = [(i, len(w), Counter(w)) for i, t in docs for w in [cut(t)] if w]
    n_docs, whole = len(bags), sum(n for _, n, _ in bags)
    df = Counter(t for _, _, bag in bags for t in bag)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(cut(t))
    out = []
    for item, terms in wanted.items():
        rows = []
        for i, n, bag in bags:
            m = 100 - 90 + 90 * n * n_docs // whole
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m)) for t in terms if t in bag)
            if score:
                rows.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(rows, key=lambda x: x[:3])[:best], 1)]
    return sorted(out, key=str)


def searched(spark, docs, items, rules):
    got = lexical_search.search(clashing(spark.createDataFrame([(i, t, "s") for i, t in docs], DOCS).repartition(3)), clashing(spark.createDataFrame(items, "item_id long, text string")), rules)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted([tuple(r) for r in got.collect()], key=str)


@pytest.mark.parametrize("rules", [SearchRules(first=5, growth=2), SearchRules(first=40, growth=3, broadcast_terms=0, broadcast_plan=0), SearchRules(), SearchRules(best=1, first=1)])
def test_search(spark, rules):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcé") for _ in range(1 + int(rnd.expovariate(0.7))))
    docs = [(i, " ".join(word() for _ in range(rnd.choice([3, 20, 60])))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(120)] + [(5, docs[5][1]), (None, docs[5][1]), (2000, None), (2001, ""), (2002, "!?"), (2003, "ABC\tabc_abc")]
    items = [(i, " ".join(word() for _ in range(rnd.choice([1, 4, 25])))) for i in range(12)] + [(50, docs[5][1]), (51, "nowhere"), (52, None), (53, ""), (1, "ABC again"), (None, "abc"), (54, "a"), (55, "a")]
    assert searched(spark, docs, items, rules) == plain_search(docs, items, rules.best)


def test_search_stops_early(spark):
    """Rare terms settle the best documents before the list of a term that all have is reached."""
    docs = [(i, f"common rare{i % 40} " + " ".join(f"w{i * 7 + j}" for j in range(8))) for i in range(2000)]
    items = [(1, "common rare3"), (2, "common rare5 rare6")]
    assert searched(spark, docs, items, SearchRules(first=60, growth=4)) == plain_search(docs, items)
    posted = spark.createDataFrame([(1, "rare", 900, 0), (1, "rare", 800, 50), (1, "common", 3, 100)], "qid long, term string, impact long, before long")
    assert {(r.term, r.level, r.rest) for r in lexical_search.plan_of(posted, 60).collect()} == {("rare", 800, 0), ("common", 800, 3)}


def test_search_empty(spark):
    none, some = [], [(1, "a b")]
    assert searched(spark, none, some, SearchRules()) == searched(spark, some, none, SearchRules()) == searched(spark, none, none, SearchRules()) == []


def test_search_long_text(spark):
    long = "zebra " + "abc " * 3_000_000 + "zebra"
    docs = [(1, long), (2, "zebra abc"), (3, "none"), (4, "nil")]
    assert searched(spark, docs, [(1, "zebra abc")], SearchRules()) == plain_search(docs, [(1, "zebra abc")])


# --- byte-level BPE


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_queue():
    rnd = random.Random(3)
    rank = [rnd.choice([-1, 5, 64, 70_000, 300_000]) for _ in range(500)]
    queue, left = byte_bpe.RankQueue(np.array(rank)), [(r, i) for i, r in enumerate(rank) if r >= 0]
    got = []
    while (r := queue.lowest()) >= 0:
        for place in queue.taken(r):
            got.append((r, place))
            if len(got) < 50 and place % 2:  # one comes up below
                queue.late.setdefault(2, []).append(place)
                queue.mark(2)
                left.append((2, place))
                break
    assert sorted(got) == sorted(left) and [x for x in got if x[0] != 2] == sorted(x for x in left if x[0] != 2)


def test_ids_as_the_library(library):
    codec, rnd = byte_bpe.ByteBpe.load(RANKS, PATTERN), random.Random(5)
    letters = "ab 'stre\n\t  0½é中՘౜\U00011de0　\x85\x1c<|>\U0001f600"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(1500)]
    texts += ["".join(rnd.choice("abetisnor") for _ in range(20_000)), "ab" * 5000 + "a" * 5001, " " * 3000 + "x", "<|endoftext|>", "", "\0\0", "x" * 9000]
    texts += [" ".join("".join(rnd.choice("etaoin") for _ in range(rnd.randrange(1, 12))) for _ in range(250_000))]  # goes through in parts
    for text in texts:
        got = codec.encode(text)
        assert got == library.encode_ordinary(text) and codec.decode(got) == text.encode()
    assert len(list(codec.parts(texts[-1]))) > 1


def test_lower_rank_comes_up(tmp_path):
    """A merge that brings up a rank below its own."""
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"cd", b"ab", b"bc", b"abcd", b"dab", b"aa", b"aaa", b"aaaa"]
    path = tmp_path / "own.tiktoken"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(tokens)))
    theirs = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    codec, rnd = byte_bpe.ByteBpe.load(str(path), PATTERN), random.Random(9)
    for n in [*range(1, 40)] * 20 + [3000]:
        text = "".join(rnd.choice("abcd") for _ in range(n))
        assert codec.encode(text) == theirs.encode_ordinary(text)


def test_byte_bpe_rows(spark, library):
    rows = [(1, "The quick brown fox's 12 jumps"), (2, None), (2, ""), (None, "É中 <|endoftext|>"), (3, "a" * 5000 + " b"), (3, "a"), (4, " ".join(["word"] * 300_000))]
    docs = clashing(spark.createDataFrame([(i, t, "s") for i, t in rows], DOCS))
    got = sorted([tuple(r) for r in byte_bpe.encode_decode_digests(docs, RANKS, PATTERN).collect()], key=str)
    want = []
    for i, t in rows:
        ids = np.array(library.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = byte_bpe.decode(byte_bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN).collect()
    assert sorted(((r.doc_id, bytes(r.bytes).decode()) for r in back), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert byte_bpe.encode_decode_digests(docs.limit(0), RANKS, PATTERN).collect() == []


# --- filter audit


def plain_audit(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    judged = []
    for i, t, source in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0d]+", t)
        fails = "".join(c for c, f in (
            ("A", len(words) < 50), ("B", 100 * len(set(words)) < 65 * len(words)), ("C", 100 * len(re.findall("[A-Z]", t)) > 5 * len(t)),
            ("D", re.search("[#$%&*|]", t) is not None), ("E", i is not None and i > least[t]),
        ) if f)
        judged.append((source or "", fails, i is not None and i in good, i is not None and i in toxic))
    out = Counter()
    for order in map("".join, permutations("ABCDE")):
        for part, fails, is_good, is_toxic in judged:
            first = next((k for k, c in enumerate(order, 1) if c in fails), 6)
            for step, c in enumerate(order, 1):
                here = first == step
                for name, n in (("kept", first > step), ("removed", here), ("redundant", c in fails and first < step), ("unique", fails == c), ("good", here and is_good), ("toxic", here and is_toxic)):
                    out[part, order, step, name] += n
                out[part, c, "shapley"] += here
    parts = {j[0] for j in judged}
    names = ("kept", "removed", "redundant", "unique", "good", "toxic")
    return sorted((p, o, s, *(out[p, o, s, k] for k in names), out[p, o[s - 1], "shapley"]) for p in parts for o in map("".join, permutations("ABCDE")) for s in range(1, 6))


def audited(spark, docs, labels):
    got = filter_audit.filter_audit(clashing(spark.createDataFrame(docs, DOCS).repartition(3)), clashing(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    return sorted(tuple(r) for r in got.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())


def test_audit(spark):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(400):
        own = rnd.choices(words[: rnd.choice([5, 400])], k=rnd.choice([0, 30, 49, 50, 80]))
        text = " ".join(w.upper() if rnd.random() < rnd.choice([0, 0.3]) else w for w in own) + rnd.choice(["", "", " #", "|"])
        docs.append((i, text, rnd.choice(["a", "b", None, ""])))
    docs += [(500 + i, docs[3][1], "hot") for i in range(200)] + [(3, docs[3][1], "a"), (3, docs[3][1], "a"), (None, docs[3][1], "a"), (None, None, None), (900, None, None), (901, "É" * 200, "b"), (902, "A\tb\x0bc", "b")]
    docs += [(903, " ".join(f"long{i % 90_001}" for i in range(200_000)), "b")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(0, 700, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    assert audited(spark, docs, labels) == plain_audit(docs, labels)


def test_audit_empty(spark):
    assert audited(spark, [], []) == []
    assert audited(spark, [(1, "x", "a")], []) == plain_audit([(1, "x", "a")], [])
