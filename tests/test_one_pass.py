"""One-pass inference against a plain loop over batches, with restarts and as a stream."""

import math
import random

import pytest

from strandtally.functions.numeric import LOG_EPSILON
from strandtally.store import new_path
from strandtally.streaming import one_pass
from strandtally.streaming.one_pass import OnePass, PassRules, step_mass, whole_pass
from strandtally.streaming.online import online_masses

RULES = PassRules(before_lengths=40, burn_in=120, longest=60)


def plain(batches, lens, rules):
    mass, lengths, seen, log_mass = dict.fromkeys(lens, rules.prior), [1 / (rules.longest + 1)] * (rules.longest + 1), 0, 0.0
    for number, rows in enumerate(batches):
        log_mass += step_mass(number + 1, rules.factor)
        m = math.exp(log_mass)
        whole = sum(lengths)
        pmf = [x / whole for x in lengths]
        cmf = [sum(pmf[: i + 1]) for i in range(len(pmf))]
        frags, add, more = {}, dict.fromkeys(lens, 0.0), [0.0] * len(lengths)
        for frag, tid, w, fl in rows:
            frags.setdefault(frag, []).append((tid, w, fl))
        for own in frags.values():
            chance = []
            for tid, w, fl in own:
                log = 0.0
                if fl is not None and seen >= rules.before_lengths:
                    p = pmf[min(fl, rules.longest)]
                    log = math.log(p) if p > 0 else LOG_EPSILON
                    if seen >= rules.burn_in:
                        c = cmf[min(lens[tid], rules.longest)]
                        log = log - math.log(c) if fl < lens[tid] and p > 0 and c > 0 else LOG_EPSILON
                chance.append(mass[tid] * w * math.exp(log) / max(lens[tid], 1))
            if sum(chance):
                for (tid, _, fl), x in zip(own, chance, strict=True):
                    add[tid] += m * x / sum(chance)
                    if fl is not None and seen < rules.burn_in:
                        more[min(fl, rules.longest)] += m * x / sum(chance)
        for t in add:
            mass[t] += add[t]
        for i, x in enumerate(more):
            for d, k in enumerate((1, 4, 6, 4, 1)):
                if 0 <= i + d - 2 <= rules.longest:
                    lengths[i + d - 2] += x * k / 16
        seen += sum(1 for own in frags.values() if any(mass[t] * w for t, w, _ in own))
    return mass, lengths


@pytest.fixture(scope="module")
def data():
    rnd = random.Random(3)
    lens = {t: rnd.choice([0, 20, 45, 50, 300]) for t in range(9)}
    batches = []
    for b in range(5):
        rows = []
        for f in range(50):
            rows += [(1000 * b + f, t, rnd.choice([0.2, 1.0]), rnd.choice([None, 10, 30, 31, 32, 48, 90])) for t in rnd.sample(range(9), rnd.choice([1, 2, 4]))]
        batches.append(rows)
    return lens, batches


def test_whole_pass(spark, data):
    lens, batches = data
    rows = [(b, *r) for b, part in enumerate(batches) for r in part]
    targets = spark.createDataFrame(list(lens.items()), "tid int, len int")
    run, last = whole_pass(spark.createDataFrame(rows, "batch int, frag long, tid int, w double, frag_len int").repartition(3), targets, RULES)
    mass, lengths = plain(batches, lens, RULES)
    assert last == 4 and {r.tid: r.mass for r in run.masses(last).collect()} == {t: pytest.approx(m, rel=1e-9) for t, m in mass.items()}
    assert {r.length: r.mass for r in run.lengths(last).collect()} == {i: pytest.approx(x, rel=1e-9) for i, x in enumerate(lengths)}
    assert run.counters(last)["fragments"] == pytest.approx(250)
    run, last = whole_pass(spark.createDataFrame([], "batch int, frag long, tid int, w double, frag_len int"), targets, RULES)
    assert last == -1 and {r.mass for r in run.masses(last).collect()} == {RULES.prior}


def test_a_step_of_a_whole_pass_is_one_job(spark, data):
    lens, batches = data
    rows = [(b, *r) for b in range(12) for r in batches[b % 5] if b != 7]
    targets = spark.createDataFrame(list(lens.items()), "tid int, len int")
    table = spark.createDataFrame(rows, "batch int, frag long, tid int, w double, frag_len int").localCheckpoint()
    spark.sparkContext.setJobGroup("whole-pass", "")
    run, last = whole_pass(table, targets, RULES)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("whole-pass"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert last == 11 and jobs < 30
    mass, _ = plain([batches[b % 5] if b != 7 else [] for b in range(12)], lens, RULES)
    assert {r.tid: r.mass for r in run.masses(last).collect()} == {t: pytest.approx(m, rel=1e-9) for t, m in mass.items()}


def test_many_targets_pass_without_the_driver(spark, data, monkeypatch):
    monkeypatch.setattr(one_pass, "MOST_HELD", 3)
    lens, batches = data
    rows = [(b, *r) for b, part in enumerate(batches[:2]) for r in part]
    targets = spark.createDataFrame(list(lens.items()), "tid int, len int")
    run, last = whole_pass(spark.createDataFrame(rows, "batch int, frag long, tid int, w double, frag_len int"), targets, RULES)
    mass, _ = plain(batches[:2], lens, RULES)
    assert {r.tid: r.mass for r in run.masses(last).collect()} == {t: pytest.approx(m, rel=1e-9) for t, m in mass.items()}


def test_stream_goes_on_after_a_restart(spark, data, tmp_path):
    lens, batches = data
    targets, folder = spark.createDataFrame(list(lens.items()), "tid int, len int"), new_path(spark, "one-pass-test")
    source, marks = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    frame = lambda part: spark.createDataFrame(part, "frag long, tid int, w double, frag_len int").coalesce(1)

    def go():
        run = OnePass(targets, RULES, folder)
        stream = spark.readStream.schema("frag long, tid int, w double, frag_len int").option("maxFilesPerTrigger", 1).parquet(source)
        stream.writeStream.foreachBatch(run).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
        return run

    for part in batches[:2]:
        frame(part).write.mode("append").parquet(source)
        go()
    for part in batches[2:4]:
        frame(part).write.mode("append").parquet(source)
        run = go()
    run(frame(batches[3]), 3)  # a batch that comes again counts once
    mass, _ = plain(batches[:4], lens, RULES)
    assert {r.tid: r.mass for r in run.masses(3).collect()} == {t: pytest.approx(m, rel=1e-9) for t, m in mass.items()}


def test_masses_of_events_with_several_targets(spark):
    rows = [(b, e, t) for b in (1, 2, 4) for e in range(5) for t in range(e % 3 + 1)]
    got = {r.tid: r.mass for r in online_masses(spark.createDataFrame(rows, "batch int, event_id long, tid int")).collect()}
    mass, log = dict.fromkeys(range(3), 0.0), 0.0
    for b in range(1, 5):
        log += step_mass(b, 0.65)
        add = dict.fromkeys(range(3), 0.0)
        for e in {e for x, e, _ in rows if x == b}:
            own = [t for x, y, t in rows if (x, y) == (b, e)]
            for t in own:
                add[t] += math.exp(log) * (mass[t] + 1) / sum(mass[u] + 1 for u in own)
        mass = {t: mass[t] + add[t] for t in mass}
    assert got == {t: pytest.approx(m) for t, m in mass.items()}
