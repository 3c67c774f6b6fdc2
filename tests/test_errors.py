"""Error models against plain loops along the CIGAR, and binomial tails against sums."""

import math
import random
import re
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from strandtally.functions.numeric import LOG_EPSILON
from strandtally.operators import errors


def plain_letters(cigar, read, ref, bins):
    """(operation, first operation, 9 * target letter + read letter, bin), letter by letter."""
    out, i, j, now = [], 0, 0, 0
    code = lambda c: max("ACGT".find(c.upper()), 0)
    for k, (n, op) in enumerate(re.findall(r"(\d+)([MIDNSHP=X])", cigar or "")):
        for at in range(int(n)):
            if (op in "MIS=X" and i >= len(read)) or (op in "MDN=X" and j >= len(ref)):
                return out
            if at and op in "MIS=X":
                now = min(i * bins // len(read), bins - 1)
            a = {"I": 4, "S": 5, "H": 6, "P": 7}.get(op) if op not in "MDN=X" else code(ref[j])
            b = {"D": 4, "N": 8, "H": 6, "P": 7}.get(op) if op not in "MIS=X" else code(read[i])
            out.append((op, k == 0, 9 * a + b, now))
            i, j = i + (op in "MIS=X"), j + (op in "MDN=X")
    return out


def cases(n, seed=1):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        ops = [(rnd.randrange(1, 9), rnd.choice("MMM=XIDNSHP")) for _ in range(rnd.randrange(1, 7))]
        need = lambda which: sum(m for m, o in ops if o in which)
        word = lambda size: "".join(rnd.choice("ACGTN") for _ in range(max(0, size)))
        short = rnd.choice([0, 0, 0, 3])
        out.append((k, k % 2, rnd.random() + 0.1, "".join(f"{m}{o}" for m, o in ops), word(need("MIS=X") - short), word(need("MDN=X") - rnd.choice([0, 0, short]))))
    return [*out, (n, 0, 1.0, None, "ACGT", "ACGT"), (n + 1, 1, 1.0, "4M", None, "ACGT"), (n + 2, 1, 1.0, "", "", "")]


SCHEMA = "frag long, side int, w double, cigar string, read string, ref string"


def test_letters():
    rows = cases(300)
    x = errors.letters([r[3] for r in rows], [r[4] for r in rows], [r[5] for r in rows], 6)
    want = [(i, errors.OPERATIONS.index(op), first, state, b) for i, r in enumerate(rows) for op, first, state, b in plain_letters(r[3], r[4] or "", r[5] or "", 6)]
    assert list(zip(x.row.tolist(), x.op.tolist(), x.opening.tolist(), x.state.tolist(), x.bin.tolist(), strict=True)) == want


def test_markov_model(spark):
    rows = cases(200, 2)
    masses, got = {}, {}
    for frag, side, w, cigar, read, ref in rows:
        prev = 81
        for _, _, cur, b in plain_letters(cigar, read or "", ref or "", 4):
            masses[side, b, prev, cur] = masses.get((side, b, prev, cur), 0) + w
            prev = cur
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = errors.transition_masses(df, 4)
    assert {(r.side, r.bin, r.prev, r.cur): pytest.approx(r.mass) for r in found.collect()} == masses
    rate = lambda s, b, p, c: math.log((masses.get((s, b, p, c), 0) + 1) / (82 + sum(m for (x, y, z, _), m in masses.items() if (x, y, z) == (s, b, p))))
    for frag, side, _, cigar, read, ref in rows:
        prev, log = 81, 0.0
        for _, _, cur, b in plain_letters(cigar, read or "", ref or "", 4):
            log += rate(side, b, prev, cur) - rate(side, b, 0, 0)
            prev = cur
        got[frag] = log if cigar else LOG_EPSILON
    scored = errors.log_error(df, errors.log_rates(found, 4), ["frag"]).collect()
    assert {r.frag: pytest.approx(r.log_err, abs=1e-9) for r in scored} == got
    assert errors.log_error(df.limit(0), errors.log_rates(found.limit(0), 4), ["frag"]).collect() == []


def test_binomial():
    rnd = np.random.default_rng(1)
    n = rnd.integers(0, 400, 300)
    k, p = (rnd.random(300) * (n + 3)).astype(int) - 1, np.append(rnd.random(297), [0.0, 1.0, 1e-4])
    want = [sum(math.comb(m, i) * q**i * (1 - q) ** (m - i) for i in range(max(0, min(a, m) + 1))) for a, m, q in zip(k.tolist(), n.tolist(), p.tolist(), strict=True)]
    assert np.allclose(errors.binomial_cdf(k, n, p), want, atol=1e-10)
    med = errors.binomial_median(n, p)
    assert (errors.binomial_cdf(med, n, p) >= 0.5 - 1e-12).all() and ((med == 0) | (errors.binomial_cdf(med - 1, n, p) < 0.5)).all()
    assert 0.4 < errors.binomial_cdf(np.array([5000]), np.array([50_000]), np.array([0.1]))[0] < 0.6


def test_long_reads(spark):
    rnd = random.Random(4)
    rows = []
    for k in range(60):
        a, b, bad = rnd.randrange(0, 30), rnd.randrange(0, 30), rnd.randrange(0, 20)
        core = "".join(rnd.choice("ACGT") for _ in range(rnd.choice([150, 280])))
        read = "A" * a + "".join("ACGT"["ACGT".index(c) ^ 1] if i < bad else c for i, c in enumerate(core)) + "C" * b
        rows.append((k, 0, 1.0, f"{a}S{len(core)}M{b}S" if a else f"{len(core)}M{b}S", read, core))
    rows += [(90, 0, 1.0, "40S", "A" * 40, "A"), (91, 0, 1.0, None, "ACGT", "A")]
    counted = errors.error_counts(spark.createDataFrame(rows, SCHEMA), ["frag", "w"])
    one = counted.filter("frag = 0").first()
    assert one.front + one.back == one.soft and one.matches + one.mismatches in (150, 280) and one.size == one.matches + one.mismatches + one.soft
    rates = errors.long_read_rates(counted).collect()
    mean = {(r.kind, r.bin): r["mean"] for r in rates}
    assert all(0 <= v < 0.2 for (k, _), v in mean.items() if k == "error")
    got = {r.frag: r for r in errors.long_read_log(counted, errors.long_read_rates(counted)).collect()}
    assert got[90].log_err == float("-inf") and got[91].log_err is not None
    for k in range(60):
        r = got[k]
        n, e = r.size - r.soft, r.mismatches
        p = mean["error", n // 100]
        cdf = lambda x, n=n, p=p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(0, int(x) + 1))
        med = next(m for m in range(n + 1) if cdf(m) >= 0.5)
        off = abs(med - e)
        want = math.log(cdf(max(med - off, 0)) + 1 - cdf(min(med + off, n)))
        for side, c in (("front", r.front), ("back", r.back)):
            m = mean[side, r.size // 100]
            want += max(0, c - math.floor(m + 0.5)) * math.log(m / (m + 1))
        assert r.log_err == pytest.approx(want, abs=1e-6)


def test_expanded_letters_take_bounded_memory():
    n = 20_000
    pdf = pd.DataFrame({"cigar": ["50M2D50M"] * n, "read": ["ACGTTGCATC" * 10] * n, "ref": ["ACGTTGCATC" * 10 + "AC"] * n})
    tracemalloc.start()
    steps = sum(len(errors._expanded(part, 6).state) for part in errors._slices(pdf))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert steps == n * 102 and peak < 120e6


def test_letters_that_are_not_there_are_not_made():
    x = errors.letters(["2S2000000000M4I", "3M"], ["ACGTT", "ACG"], ["ACG", "AC"], 6)
    assert x.row.tolist() == [0] * 5 + [1] * 2 and x.op.tolist() == [4, 4, 0, 0, 0, 0, 0]


def test_alignments_are_expanded_once_for_rates_and_scores(spark):
    import __spark_entry__

    plan = __spark_entry__.queries()["long_read_likelihoods"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "MapInPandas" not in plan and "regexp_replace" not in plan


def test_scored_alignments_are_made_once(spark):
    import __spark_entry__

    plan = __spark_entry__.queries()["error_likelihoods"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "MapInPandas" in plan and "regexp_replace" not in plan
