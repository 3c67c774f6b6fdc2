"""Chains against a plain dynamic program over all pairs of seeds."""

import random

import numpy as np
import pytest

from strandtally.operators import chaining, mapping, slices
from strandtally.store import stored



def plain(seeds, k, most_gap):
    """(score, first, seeds, bases) of the best chain that ends with each of the seeds (pos, rpos), which are in order."""
    out = []
    for j, (t, r) in enumerate(seeds):
        best, came = 20 * k, (j, 1, k)
        for i in range(j):
            ti, ri = seeds[i]
            if ri <= r - k and ti <= t - k and t - ti - k <= most_gap:
                value = out[i][0] + 20 * k - (r - ri - k) - (t - ti - k)
                if value >= best and value > 20 * k:
                    best, came = value, (out[i][1], out[i][2] + 1, out[i][3] + k)
        line = [i for i in range(j) if seeds[i][0] - seeds[i][1] == t - r and 0 < r - seeds[i][1] < k]
        if line:
            i = line[-1]
            value = out[i][0] + 20 * (r - seeds[i][1])
            if value >= best:
                best, came = value, (out[i][1], out[i][2] + 1, out[i][3] + r - seeds[i][1])
        out.append((best, *came))
    return out


def some_groups(seed, n, wide):
    rnd = random.Random(seed)
    groups = []
    for _ in range(n):
        size = rnd.choice([1, 1, 2, 3, 8, 40, 90])
        own = {(rnd.randrange(wide), rnd.randrange(wide)) for _ in range(size)}
        for _ in range(rnd.choice([0, 1, 2])):  # and whole diagonals
            t, r = rnd.randrange(wide), rnd.randrange(wide)
            own |= {(t + i, r + i) for i in range(rnd.randrange(20))}
        groups.append(sorted(own))
    return groups


@pytest.mark.parametrize("k, most_gap, wide", [(5, 40, 60), (3, 10, 200), (7, 10_000, 120)])
def test_scores(k, most_gap, wide):
    """Best scores are the optimum's; where several chains have it, the one reported really has that score."""
    groups = some_groups(k, 500, wide)
    g = np.repeat(np.arange(len(groups)), [len(x) for x in groups])
    pos, rpos = np.array([s for x in groups for s in x]).T
    score, first, seeds, bases = chaining.chain_seeds(g, rpos, pos, k, most_gap)
    want = [w for x in groups for w in plain(x, k, most_gap)]
    assert score.tolist() == [w[0] for w in want]
    assert (seeds >= 1).all() and (bases >= k).all() and (bases <= k * seeds).all() and (g[first] == g).all() and (score <= 20 * bases).all()


def test_one_large_group():
    seeds = some_groups(1, 1, 50)[0] + sorted({(50 + i, (i * 37) % 500) for i in range(1500)})
    pos, rpos = np.array(seeds).T
    score = chaining.chain_seeds(np.zeros(len(seeds), np.int64), rpos, pos, 4, 100)[0]
    assert score.tolist() == [w[0] for w in plain(seeds, 4, 100)]


def test_small_groups_go_together(monkeypatch):
    """Without the tree, which takes large groups one by one, and with the same result as from it."""
    groups = [*some_groups(2, 60, 80), *some_groups(3, 20, 2000), sorted({(i % 300, (i * 37) % 500) for i in range(1500)})]
    g = np.repeat(np.arange(len(groups)), [len(x) for x in groups])
    pos, rpos = np.array([s for x in groups for s in x]).T
    sweep, alone = chaining._sweep, []
    monkeypatch.setattr(chaining, "_sweep", lambda rpos, *more: alone.append(len(rpos)) or sweep(rpos, *more))
    together = chaining.chain_seeds(g, rpos, pos, 5, 60)
    assert not alone
    monkeypatch.setattr(chaining, "DENSE", 1)
    by_tree = chaining.chain_seeds(g, rpos, pos, 5, 60)
    assert alone and all((a == b).all() for a, b in zip(together, by_tree, strict=True))


def test_reads_on_both_strands(spark):
    rnd = random.Random(3)
    target = "".join(rnd.choice("ACGT") for _ in range(900))
    back = target[::-1].translate(str.maketrans("ACGT", "TGCA"))
    insert = target[100:160] + "ACGTT" + target[160:220]  # five letters too many
    reads = spark.createDataFrame([(1, target[300:400]), (2, back[200:320]), (3, insert), (4, "ACG"), (5, None), (1, target[300:400])], "frag long, seq string")
    targets = spark.createDataFrame([(7, target), (8, target[500:])], "tid int, seq string")
    hits = mapping.stranded_hits(reads.distinct(), targets, 15)
    got = {(r.frag, r.tid): r for r in chaining.collinear_chains(hits, 15, 500, seeds_each=50).collect()}
    assert (got[1, 7].fwd, got[1, 7].first, got[1, 7].last, got[1, 7].start, got[1, 7].stop, got[1, 7].bases) == (True, 0, 100, 300, 400, 100)
    assert (got[2, 7].fwd, got[2, 7].start, got[2, 7].stop, got[2, 7].first) == (False, 580, 700, 0)
    assert (got[2, 8].fwd, got[2, 8].start, got[2, 8].stop) == (False, 80, 200)
    assert (got[3, 7].bases >= 118, got[3, 7].start, got[3, 7].stop, got[3, 7].last) == (True, 100, 220, 125)
    assert set(got) == {(1, 7), (2, 7), (2, 8), (3, 7)}
    assert chaining.collinear_chains(hits.limit(0), 15, 500).collect() == []


def plain_score(a, b, band=15):
    """Global alignment with affine gaps within a band, cell by cell."""
    low, w = -(10**8), max(band, abs(len(a) - len(b)))
    best, gap_a, gap_b = ({} for _ in range(3))
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if abs(i - j) > w:
                continue
            get = lambda table, x, y: table.get((x, y), low)
            gap_a[i, j] = max(get(best, i - 1, j) - 8, get(gap_a, i - 1, j) - 2)
            gap_b[i, j] = max(get(best, i, j - 1) - 8, get(gap_b, i, j - 1) - 2)
            here = 0 if i == j == 0 else get(best, i - 1, j - 1) + (2 if i and j and a[i - 1] == b[j - 1] else -4)
            best[i, j] = max(here, gap_a[i, j], gap_b[i, j])
    return best[len(a), len(b)]


def test_banded_scores():
    rnd = random.Random(8)
    pairs = []
    for _ in range(150):
        a = "".join(rnd.choice("ACGT") for _ in range(rnd.randrange(0, 60)))
        b = "".join(c if rnd.random() > 0.1 else rnd.choice(["", "A", c + "G"]) for c in a) if rnd.random() < 0.7 else "".join(rnd.choice("ACGT") for _ in range(rnd.randrange(0, 60)))
        pairs.append((a, b))
    for band in (2, 15):
        assert mapping.banded_scores([a for a, _ in pairs], [b for _, b in pairs], band).tolist() == [plain_score(a, b, band) for a, b in pairs]


def test_slices(spark):
    rnd = random.Random(2)
    seqs = {i: "".join(rnd.choice("ACGT") for _ in range(n)) for i, n in enumerate([0, 1, 63, 64, 65, 1000])}
    wanted = [(i, i % 6, a, a + rnd.randrange(0, len(seqs[i % 6]) - a + 1)) for i in range(300) if seqs[i % 6] for a in [rnd.randrange(len(seqs[i % 6]))]]
    targets = spark.createDataFrame(list(seqs.items()) + [(9, None)], "tid int, seq string")
    rows = spark.createDataFrame(wanted, "frag long, tid int, from long, to long")
    got = slices.with_slices(rows, slices.target_blocks(targets, 64, 16), 64, 16).collect()
    assert sorted((r.frag, r.slice) for r in got) == sorted((f, seqs[t][a:b]) for f, t, a, b in wanted)


def test_scores_of_chains_and_rescue(spark):
    rnd = random.Random(4)
    target = "".join(rnd.choice("ACGT") for _ in range(30_000))
    flip = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    at = 16_350  # over the edge of a block
    worn = target[at + 200 : at + 250]
    worn = "".join(("A" if c != "A" else "C") if i % 12 == 11 else c for i, c in enumerate(worn))
    reads = spark.createDataFrame([(1, target[at : at + 100]), (2, flip(target[500:540] + "AAC" + target[540:600])), (3, target[100:140] + "ACGT" * 20)], "frag long, seq string")
    targets = spark.createDataFrame([(7, target)], "tid long, seq string")
    chains = chaining.collinear_chains(mapping.stranded_hits(reads, targets, 15), 15, 500)
    got = {r.frag: r for r in mapping.score_chains(chains, reads, targets).collect()}
    assert set(got) == {1, 2} and (got[1].pos, got[1].score) == (at, 200) and (got[2].fwd, got[2].score >= 200 - 6 - 6 - 6) == (False, True)
    mates = spark.createDataFrame([(1, flip(worn)), (2, worn)], "frag long, seq string")
    none = chaining.collinear_chains(mapping.stranded_hits(mates, targets, 15), 15, 500)
    found = mapping.rescue(mapping.missing_mates(chains, none, mates, targets, 300), 6).collect()
    assert [(r.frag, r.tid, r.edits) for r in found] == [(1, 7, 4)] and abs(found[0].at - at - 250) <= 1  # of equal ends the first


@pytest.mark.parametrize("stranded", [False, True])
def test_reads_in_rounds(spark, monkeypatch, stranded):
    rnd = random.Random(11)
    parts = ["".join(rnd.choices("ACGT", k=60)) for _ in range(5)]
    texts = ["".join(rnd.sample(parts, 3)) for _ in range(40)]
    targets = spark.createDataFrame(list(enumerate(texts)), "tid long, seq string")
    reads = spark.createDataFrame([(i, "".join(rnd.sample(parts, 2))) for i in range(30)] + [(99, None)], "frag long, seq string")
    index = mapping.stranded_index(targets, 15) if stranded else mapping.rare_kmers(mapping.kmer_index(targets, 15), 1000)
    rounds = []
    monkeypatch.setattr(mapping, "stored", lambda df, name: rounds.append(name) or stored(df, name))
    then = (lambda hits: mapping.sketch_strands(hits, 15)) if stranded else mapping.sketch_map
    once = sorted(map(tuple, mapping.in_rounds(reads, index, 15, then, stranded, most_hits=10**9).collect()))
    assert not rounds
    many = sorted(map(tuple, mapping.in_rounds(reads, index, 15, then, stranded, most_hits=2_000).collect()))
    assert len(rounds) > 2 and once and many == once
