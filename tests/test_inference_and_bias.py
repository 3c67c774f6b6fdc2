"""Resampling, bounds, k-mers, bias and restarts against plain versions."""

import math
import random
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandtally.functions import formats
from strandtally.functions import sequences as seq
from strandtally.operators import bias, classes, graph, inference, kmers, mapping, ranks
from strandtally.sources import readers, writers
from strandtally.streaming.online import OnlinePass, log_masses


def test_bounds_that_are_freed_again(spark):
    assert graph.fit_bounds([8, 2], [0, 3], [6, 10], 10) == pytest.approx([6, 4])
    rng = random.Random(5)
    rows, want = [], {}
    for c in range(30):
        n = rng.randint(1, 6)
        low = [rng.randint(0, 5) for _ in range(n)]
        high = [x + rng.randint(0, 9) for x in low]
        total = rng.randint(sum(low), sum(high))
        guess = [rng.uniform(0.1, 10) for _ in range(n)]
        fitted = graph.fit_bounds(guess, low, high, total)
        for i in range(n):
            rows.append((c, 100 * c + i, guess[i], low[i], high[i], total))
            want[100 * c + i] = fitted[i]
    counts = spark.createDataFrame(rows, "component long, tid long, projected double, uniq long, total long, n long")
    got = {r.tid: r.fitted for r in graph.project_to_bounds(counts).collect()}
    assert got == pytest.approx(want, abs=1e-6)
    for c in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == c]
        if sum(got[r[1]] for r in own) > 0:
            assert sum(got[r[1]] for r in own) == pytest.approx(own[0][5], abs=1e-6) and all(r[3] - 1e-6 <= got[r[1]] <= r[4] + 1e-6 for r in own)


def test_multinomial_draws_keep_the_total(spark):
    counts = spark.createDataFrame([(str(i), i) for i in range(1, 60)], "key string, n long")
    got = inference.resample(counts, 40, classes_each=10).collect()
    total = Counter()
    mean = Counter()
    for r in got:
        total[r.sample_id] += r.n
        mean[r.key] += r.n / 40
    assert set(total.values()) == {sum(range(1, 60))} and len(total) == 40
    assert all(abs(mean[str(i)] - i) < 5 * math.sqrt(i / 40) for i in range(1, 60))
    one = spark.createDataFrame([("0", 1), ("1", 1)], "key string, n long")
    assert {r.n for r in inference.resample(one, 50).collect()} == {0, 1, 2}


def test_classes_are_dealt_as_multinomials():
    rng = np.random.default_rng(3)
    cls, p = np.array([0, 0, 0, 1, 2, 2]), np.array([1.0, 2, 7, 5, 0, 0])
    n = np.array([1000, 1000, 1000, 50, 9, 9])
    got = np.array([inference.deal_classes(cls, n, p, rng) for _ in range(200)])
    assert (got[:, :3].sum(1) == 1000).all() and (got[:, 3] == 50).all() and (got[:, 4:] == 0).all()
    assert got[:, :3].mean(0) == pytest.approx([100, 200, 700], rel=0.03) and got[:, 2].std() == pytest.approx(math.sqrt(1000 * 0.7 * 0.3), rel=0.2)


def test_gibbs_follows_weights_and_lengths(spark):
    c = spark.createDataFrame([("0", 3000), ("1", 1000), ("0,1", 4000)], "key string, n long")
    m = classes.members(c).withColumn("w", F.lit(1.0))
    lengths = spark.createDataFrame([(0, 100.0), (1, 100.0)], "tid int, eff_len double")
    got = inference.gibbs(m, 2, 4, thinning=5, lengths=lengths).groupBy("tid").agg(F.avg("alpha").alias("a")).collect()
    assert {r.tid: r.a for r in got} == pytest.approx({0: 6000, 1: 2000}, rel=0.1)


def test_start_and_weights(spark):
    projected = spark.createDataFrame([(0, 30.0), (1, 10.0)], "tid int, projected double")
    assert {r.tid: r.alpha for r in inference.start(projected, required=80).collect()} == {0: 25.0, 1: 15.0}
    own = spark.createDataFrame([(0, 9, 1000.0), (1, 0, 1000.0)], "tid int, unique_count long, eff_len double")
    assert {r.tid: r.alpha for r in inference.start(projected, required=80, own=own).collect()} == pytest.approx({0: 15 + 4.75, 1: 5 + 0.25})
    m = spark.createDataFrame([("0,1", 0, 0.5), ("0,1", 1, 0.5)], "key string, tid int, w double")
    short = spark.createDataFrame([(0, 0.5), (1, 2.0)], "tid int, eff_len double")
    assert sorted(r.w for r in classes.length_weights(m, short).collect()) == pytest.approx([1 / 3, 2 / 3])
    assert sorted(r.w for r in classes.length_weights(m, short, least=0.0).collect()) == pytest.approx([0.2, 0.8])
    assert inference.gibbs_prior(0.01, True) == 1.0 and inference.gibbs_prior(0.01, True, True) == 0.01 and inference.gibbs_prior() == 1e-3


def test_running_sums_and_ranks(spark):
    rng = random.Random(2)
    values = [rng.randint(0, 40) for _ in range(300)]
    got = {r.value: (r.n, r.upto) for r in ranks.value_ranks(spark.createDataFrame([(v,) for v in values], "x int"), "x").collect()}
    assert got == {v: (values.count(v), sum(w <= v for w in values)) for v in set(values)}


def test_kmer_numbers(spark):
    texts = ["ACGTNACGTA", "acg", "", None, "TTTTT", "NNNNNN"]
    row, at, code = kmers.codes(pa.array(texts), 3)
    want = [(i, k, int("".join("0123"["ACGT".index(c)] for c in t.upper()[k : k + 3]), 4)) for i, t in enumerate(texts) if t for k in range(len(t) - 2) if set(t.upper()[k : k + 3]) <= set("ACGT")]
    assert list(zip(row.tolist(), at.tolist(), code.tolist(), strict=True)) == want
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "tid long, seq string")
    turn = str.maketrans("ACGT", "TGCA")
    n, held = Counter(), {}
    for i, k, _ in want:
        x = texts[i].upper()[k : k + 3]
        x = min(x, x[::-1].translate(turn))
        n[x] += 1
        held.setdefault(x, set()).add(i)
    got = {r.k: (r.n, r.targets) for r in kmers.kmer_counts(df, 3).select(seq.kmer_text(F.col("kmer"), 3).alias("k"), "n", "targets").collect()}
    assert got == {x: (c, len(held[x])) for x, c in n.items()}
    for k in (0, 4, 33):
        with pytest.raises(ValueError):
            kmers.check_k(k)


def test_gapped_chains(spark):
    # two runs, three letters of the target skipped between them; a third one far away on the target
    hits = [(1, r, 7, r + 100) for r in (0, 1, 2, 10)] + [(1, r, 7, r + 103) for r in (30, 31)] + [(1, 40, 7, 5000)]
    got = mapping.gapped_chains(spark.createDataFrame(hits, "frag long, rpos int, tid long, pos int"), 5, 500).orderBy("start").collect()
    assert [(r.seeds, r.bases, r["first"], r["last"], r.start, r.stop) for r in got] == [(6, 18, 0, 36, 100, 139), (1, 5, 40, 45, 5000, 5005)]
    both = spark.createDataFrame([(1, 1, 1, 100), (1, 2, 1, 60), (1, 2, 2, 90), (1, 1, 2, 70)], "frag long, tid long, chain long, bases long")
    kept = lambda **how: sorted((r.tid, r.chain) for r in mapping.consensus_filter(both, **how).collect())
    assert kept() == [(1, 1), (2, 2)] and kept(when="none") == [(1, 1), (1, 2), (2, 1), (2, 2)] and kept(when="before") == [(1, 1), (1, 2), (2, 2)] and kept(share=1.0, of_best=1.0) == [(1, 1)]


def test_batched_scores():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 12)))
    low = -(10**9)

    def plain(read, target, band):
        n, m = len(read), len(target)
        width = max(band, abs(n - m))
        h, e, f = ([[low] * (m + 1) for _ in range(n + 1)] for _ in range(3))
        for i in range(n + 1):
            for j in range(m + 1):
                if abs(i - j) > width:
                    continue
                if not i and not j:
                    h[i][j] = 0
                    continue
                if i:
                    e[i][j] = max(h[i - 1][j] - mapping.GAP_OPEN, e[i - 1][j]) - mapping.GAP_EXTEND
                if j:
                    f[i][j] = max(h[i][j - 1] - mapping.GAP_OPEN, f[i][j - 1]) - mapping.GAP_EXTEND
                diagonal = h[i - 1][j - 1] + (mapping.MATCH if read[i - 1] == target[j - 1] else mapping.MISMATCH) if i and j else low
                h[i][j] = max(diagonal, e[i][j], f[i][j])
        return h[n][m]

    pairs = [(word(), word()) for _ in range(300)]
    for band in (1, 3, 15):
        got = mapping.banded_scores([a for a, _ in pairs], [b for _, b in pairs], band)
        assert got.tolist() == [plain(a, b, band) for a, b in pairs]

    def edits(q, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(q, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
            row = new
        return min(row), row.index(min(row))

    e, at = mapping.infix_distances([a for a, _ in pairs], [b for _, b in pairs])
    assert list(zip(e.tolist(), at.tolist(), strict=True)) == [edits(a, b) for a, b in pairs]


def test_pair_lengths(spark):
    lit = F.lit
    got = spark.range(1).select(
        formats.inner_length(lit(True), lit(10), lit(50), lit(False), lit(100), lit(40), lit(1000)), formats.inner_length(lit(False), lit(10), lit(50), lit(True), lit(-5), lit(40), lit(30)),
        formats.inner_length(lit(True), lit(1), lit(5), lit(True), lit(9), lit(5), lit(99)), formats.span_length(lit(10), lit(50), lit(100), lit(40)), formats.log_prior(lit(False)), formats.log_prior(lit(True), 0.5),
    ).first()
    assert tuple(got) == (130, 30, 0, 130, float("-inf"), 0.0)


def test_corrected_length_by_plain_loops():
    rng = random.Random(6)
    s = "".join(rng.choice("ACGT") for _ in range(90))
    share = np.array([math.exp(-(((x - 30) / 6) ** 2) / 2) for x in range(61)])
    share /= share.sum()
    cmf = np.cumsum(share)
    r = np.random.default_rng(1)
    m = bias.Models(r.uniform(0.5, 2, 4**9), r.uniform(0.5, 2, 4**9), r.uniform(0.5, 2, (bias.CONTEXTS, bias.BINS)), (r.uniform(1, 2, (5, 20)), r.uniform(1, 2, (5, 20))), (r.uniform(1, 2, (5, 20)), r.uniform(1, 2, (5, 20))))
    low, high, n = 15, 45, len(s)
    code = lambda x: int("".join(str("ACGT".index(c)) for c in x), 4)
    turn = lambda x: x[::-1].translate(str.maketrans("ACGT", "TGCA"))
    gc = lambda x: sum(c in "GC" for c in x)
    percent = lambda x: round(100 * gc(x) / len(x))
    place = {k: bias.spline(p[0][2])(np.arange(n) / n) / bias.spline(p[1][2])(np.arange(n) / n) for k, p in (("5", m.pos5), ("3", m.pos3))}
    total, before = 0.0, low - 1
    top = min(n, high + 1)
    for length in [*range(low, top - 1, 5), top - 1]:
        w = (cmf[length] - cmf[before]) / cmf[min(n, 60)]
        before = length
        for a in range(n - length):
            e = a + length - 1
            f = m.seq5[code(s[a - 3 : a + 6])] if 3 <= a <= n - 6 else 1.0
            b = m.seq3[code(turn(s[e - 5 : e + 4]))] if 5 <= e <= n - 4 else 1.0
            around = s[max(a - 3, 0) : a + 2] + s[max(e - 1, 0) : e + 4]
            g = m.gc[min(2, int(percent(around) * 3 / 100)), min(24, int(percent(s[a : e + 1]) * 25 / 100))]
            total += w * f * b * g * place["5"][a] * place["3"][e]
    assert bias.corrected_length(s, 20.0, 2, m, cmf, low, high) == pytest.approx(max(total, min(20.0, n - 20.0)), rel=1e-9)
    plain = bias.corrected_length(s, 1e-9, 0, bias.Models(), cmf, low, high, step=1)
    assert plain == pytest.approx(sum((cmf[x] - cmf[x - 1]) / cmf[60] * (n - x) for x in range(low, high + 1)))
    assert bias.due(11, False, False) and bias.due(3, True, False) and not bias.due(50, True, True) and not bias.due(10, False, False)


def test_spline_goes_through_its_knots():
    masses = np.array([1.0, 3, 2, 4])
    at = bias.spline(masses)
    whole = 10 + 0.1 + 0.4
    assert at(np.array([0.0, 0.24, 0.49, 0.74])) == pytest.approx([0.1, 1 / whole, 3 / whole, 2 / whole]) and (bias.spline(np.array([1e-9, 1, 1e-9]))(np.linspace(0, 1, 50)) >= 0.001).all()


def test_models_of_unbiased_fragments(spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("ACGT") for _ in range(300)), 1.0, 200.0, 0) for i in range(6)]
    targets = spark.createDataFrame(rows, "tid long, seq string, alpha double, eff_len double, length_class int")
    cmf = np.concatenate([np.zeros(50), np.ones(60)])  # all fragments have 50 letters
    every = [(t, a, a + 50, 1 / 200, 0, s) for t, s, *_ in rows for a in range(250)]
    o = bias.observed_models(spark.createDataFrame(every, "tid long, start long, stop long, w double, length_class int, seq string"))
    e = bias.expected_models(targets, cmf, 49, 50, step=1)
    key = lambda df: {(r.model, r.a, r.b): r.mass for r in df.collect()}
    assert key(o) == pytest.approx(key(e))
    m = bias.models_of(o, e)
    assert m.seq5 == pytest.approx(np.ones(4**9)) and m.gc == pytest.approx(np.ones(m.gc.shape))
    assert bias.enough_background(targets)


def test_class_tables(spark, tmp_path):
    c = spark.createDataFrame([("0", 3), ("0,1", 7)], "key string, n long")
    w = spark.createDataFrame([("0", 0, 1.0), ("0,1", 0, 0.25), ("0,1", 1, 0.75)], "key string, tid int, w double")
    t = spark.createDataFrame([(0, "a b"), (1, "b")], "tid int, name string")
    writers.write_classes(c, t, str(tmp_path / "w"), w)
    targets, members = readers.read_class_tables(spark, str(tmp_path / "w"))
    assert {(r.tid, r.name) for r in targets.collect()} == {(0, "a b"), (1, "b")}
    assert sorted((r.key, r.n, r.tid, r.w) for r in members.collect()) == [("0", 3, 0, 1.0), ("0,1", 7, 0, 0.25), ("0,1", 7, 1, 0.75)]


def test_fasta_over_blocks(spark, tmp_path):
    (tmp_path / "t.fa").write_text("junk\n" + "".join(f">t{i}\n" + "ACGT\n" * (i % 7) for i in range(40)))
    got = {r.name: r.seq for r in readers.read_fasta(spark, str(tmp_path / "t.fa"), lines_each=5).collect()}
    assert got == {f"t{i}": "ACGT" * (i % 7) for i in range(40)}


def test_online_pass_goes_on_after_a_restart(spark, tmp_path):
    for k in range(4):
        spark.createDataFrame([(10 * k + i, i % 3) for i in range(10)], "frag long, tid int").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    start = spark.createDataFrame([(i, 0.0) for i in range(3)], "tid int, mass double")

    def stream(paths):
        online = OnlinePass(start, folder=f"file://{tmp_path}/states")  # nothing of the one before
        rows = spark.readStream.schema("frag long, tid int").option("maxFilesPerTrigger", 1).parquet(paths)
        rows.writeStream.foreachBatch(online).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sum(r.mass for r in online.state.collect())

    for k in (2, 3):
        (tmp_path / f"in/{k}").rename(tmp_path / f"later{k}")
    assert stream(str(tmp_path / "in/*")) == pytest.approx(10 * sum(math.exp(m) for m in log_masses(2)))
    for k in (2, 3):
        (tmp_path / f"later{k}").rename(tmp_path / f"in/{k}")
    assert stream(str(tmp_path / "in/*")) == pytest.approx(10 * sum(math.exp(m) for m in log_masses(4)))


def plain_bias_run(members, lengths, correct, tolerance, first, least):
    """Rounds of expectation maximisation with one correction, in plain Python: members (key, n, tid, w)."""
    classes = {}
    for key, n, tid, w in members:
        classes.setdefault(key, (n, []))[1].append((tid, w))

    def weighted(by, floor):
        return {k: (n, [(t, w / max(by[t], floor)) for t, w in ms]) for k, (n, ms) in classes.items()}

    alpha, rounds, settled, corrected = {t: 1.0 for _, _, t, _ in members}, 0, False, False
    now = weighted(lengths, 1.0)
    while True:
        if not corrected and (rounds > first or settled):
            lengths, corrected = correct(alpha), True
            now, settled = weighted(lengths, 1e-300), False
        if corrected and settled and rounds >= least:
            return alpha, lengths, rounds
        new = dict.fromkeys(alpha, 0.0)
        for n, ms in now.values():
            whole = sum(alpha[t] * w for t, w in ms)
            for t, w in ms:
                new[t] += n * alpha[t] * w / whole
        change = max(abs(new[t] - alpha[t]) / new[t] for t in new if new[t] > 1e-2)
        alpha, rounds = new, rounds + 1
        settled = change <= tolerance and (rounds >= least if corrected else True)


def test_bias_run(spark):
    rnd = random.Random(12)
    members = []
    for k in range(60):
        tids = rnd.sample(range(12), rnd.choice([1, 2, 3]))
        n = rnd.randrange(1, 40)
        members += [(f"c{k}", n, t, 1 / len(tids)) for t in tids]
    lengths = {t: float(rnd.randrange(20, 400)) for t in range(12)}
    calls = []

    def corrected(alpha):
        return {t: lengths[t] * (1 + alpha[t] / sum(alpha.values())) for t in lengths}

    def correct(df):
        calls.append(1)
        if len(calls) == 1:
            raise OSError("the driver is lost")  # after the first rounds are saved
        return spark.createDataFrame(list(corrected({r.tid: r.alpha for r in df.collect()}).items()), "tid int, eff_len double")

    from strandtally.store import new_path

    folder = new_path(spark, "bias-run-test")
    frame = spark.createDataFrame(members, "key string, n long, tid int, w double")
    start = lambda: inference.BiasRun(frame, spark.createDataFrame(list(lengths.items()), "tid int, eff_len double"), correct, folder, tolerance=1e-3, least_rounds=20, save_every=7)
    with pytest.raises(OSError):
        start().run()
    assert start().state()[1:] == (11, False, False) or start().state()[2]
    run = start()
    got = {r.tid: r.alpha for r in run.run().collect()}
    want, by, rounds = plain_bias_run(members, dict(lengths), corrected, 1e-3, 10, 20)
    assert len(calls) == 2 and run.state()[1] == rounds
    assert got == {t: pytest.approx(v, rel=1e-6) for t, v in want.items()}
    assert {r.tid: r.eff_len for r in run.lengths().collect()} == {t: pytest.approx(v) for t, v in by.items()}
    assert {r.tid: r.alpha for r in start().run().collect()} == got and len(calls) == 2  # nothing left to do


def test_bias_sample(spark):
    rows = [(f, f % 7 + k, 10 * k, 10 * k + 50) for f in range(500) for k in range(f % 3 + 1)]
    df = spark.createDataFrame(rows, "frag long, tid long, start long, stop long")
    every = {r.frag: tuple(r) for r in bias.bias_sample(df, 1000).collect()}
    assert set(every) == set(range(500)) and all(x in rows for x in every.values()) and len({x[2] for x in every.values()}) > 1
    some = [tuple(r) for r in bias.bias_sample(df.repartition(7), 100).collect()]
    assert len(some) == 100 and all(every[x[0]] == x for x in some)
    assert set(some) <= set(tuple(r) for r in bias.bias_sample(df.repartition(2), 150).collect())


def test_background_leaves_out_auxiliary(spark):
    t = spark.createDataFrame([(1, "ACGT" * 20, 5.0, False), (2, "GGCC" * 20, 5.0, True), (3, "GGCC" * 20, 0.0, False), (4, "GGCC" * 20, 1.0, None)], "tid int, seq string, alpha double, auxiliary boolean")
    assert sorted(r.tid for r in bias.background(t).collect()) == [1, 4] and bias.enough_background(t) and not bias.enough_background(t.filter("tid = 2"))


def test_hashed_gamma():
    keys = np.arange(200_000)
    for shape in (0.3, 1.0, 7.5):
        x = inference.hashed_gamma(np.full(len(keys), shape), 1, 2, keys)
        assert x.mean() == pytest.approx(shape, rel=0.02) and x.var() == pytest.approx(shape, rel=0.04) and (x > 0).all()
        assert np.array_equal(x[500:600], inference.hashed_gamma(np.full(100, shape), 1, 2, keys[500:600]))
        assert np.mean(x <= np.median(np.random.default_rng(1).gamma(shape, size=200_000))) == pytest.approx(0.5, abs=0.01)


def test_posterior_draws(spark):
    """Two targets that share a class and have one each: draws agree with a plain sampler in mean, and keep totals."""
    rows = [("1", 300, 1, 1.0), ("2", 100, 2, 1.0), ("1,2", 600, 1, 0.5), ("1,2", 600, 2, 0.5), ("3", 50, 3, 0.0)]
    m = spark.createDataFrame(rows, "key string, n long, tid int, w double")
    lengths = spark.createDataFrame([(1, 100.0), (2, 300.0), (3, 10.0)], "tid int, eff_len double")
    got = inference.posterior_draws(m, 24, lengths, thinning=2).collect()
    assert sorted({r.sample_id for r in got}) == list(range(24))
    sums = Counter()
    for r in got:
        sums[r.sample_id] += r.alpha
    assert all(v == pytest.approx(1050) for v in sums.values())
    raw = inference.posterior_draws(m, 24, lengths, thinning=2, rescaled=False, variational=True, prior=0.01, by_base=True).collect()
    by = {t: [r.alpha for r in raw if r.tid == t] for t in (1, 2, 3)}
    assert set(by[3]) == {50.0} and all(a + b == 1000 for a, b in zip(by[1], by[2], strict=True)) and len(set(by[1])) > 5
    rng, a, keep = np.random.default_rng(3), [600.0, 400.0], []
    for i in range(4000):
        mu = [rng.gamma(a[0] + 1.0) / 100.1, rng.gamma(a[1] + 3.0) / 300.1]
        k = rng.binomial(600, mu[0] / sum(mu))
        a = [300 + k, 700 - k]
        keep.append(a[0])
    assert np.mean(by[1][4:]) == pytest.approx(np.mean(keep[100:]), rel=0.05)
    assert [inference.chains_for(n) for n in (1, 49, 50, 99, 100, 199, 200)] == [1, 1, 2, 2, 4, 4, 8]
    assert sorted(map(tuple, inference.posterior_draws(m.repartition(5), 24, lengths, thinning=2).collect())) == sorted(map(tuple, got))


def test_expected_sums_are_those_of_every_fragment():
    """Arrays summed by start against every fragment one by one, and no more than a moment for a long target."""
    rnd, cmf = random.Random(5), np.cumsum([0.0] * 20 + [1 / 30] * 30)
    sums, cells = bias._Sums(5), {}
    for n, cls in ((0, 0), (9, 1), (25, 2), (400, 3), (55, 6)):
        t = bias.Target("".join(rnd.choices("ACGT", k=n)))
        sums.add(t, 0.7, cls, cmf, 21, 48, 5)
        for length, share in bias.length_steps(cmf, t.n, 21, 48, 5):
            start = np.arange(max(t.n - length, 0))
            if share > 0:
                w = np.full(len(start), 0.7 * share)
                bias._fragments(cells, t, start, start + length - 1, w, w, w, np.full(len(start), cls))
    got = {(r.model, r.a, r.b): r.mass for r in sums.cells().itertuples()}
    assert set(got) == set(cells) and got == {k: pytest.approx(v, rel=1e-9) for k, v in cells.items()}
    began = time.process_time()
    bias._Sums(5).add(bias.Target("ACGTTGCA" * 250_000), 1.0, 0, np.cumsum([0.0] * 60 + [1 / 120] * 120), 60, 179, 5)
    assert time.process_time() - began < 5


def test_counted_letters_take_bounded_memory():
    batch = pa.RecordBatch.from_pydict({"seq": ["ACGTTGCATC" * 100] * 9_000})
    tracemalloc.start()
    whole = sum(len(kmers.codes(part.column("seq"), 15, True)[2]) for part in kmers.parts(batch, "seq", kmers.COUNTED))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert whole == 9_000 * 986 and peak < 150e6
