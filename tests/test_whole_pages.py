"""Seeds over whole pages, against plain versions."""

from collections import Counter, defaultdict

import duckdb

from strandtally.plans import queries
from strandtally.plans.frames import sequences

from .test_queries import DATA


def test_seeds_of_whole_pages(spark):
    index, count, targets = defaultdict(list), Counter(), defaultdict(set)
    for r in sequences(spark, DATA).collect():
        for i in range(len(r.seq) - 14):
            x = r.seq[i : i + 15]
            index[x].append((r.tid, i))
            x = min(x, x[::-1].translate(str.maketrans("ACGT", "TGCA")))
            count[x] += 1
            targets[x].add(r.tid)
    pages = duckdb.sql(f"SELECT page_id, upper(regexp_replace(html, '[^acgtACGT]', '', 'g')) FROM '{DATA}/pages.parquet'").fetchall()
    assert any(len(s) > 200 for _, s in pages)
    n, chains, places = Counter(), defaultdict(list), defaultdict(set)
    for f, s in pages:
        for i in range(len(s) - 14):
            at = index.get(s[i : i + 15], ())
            for t, k in at if len(at) <= 1000 else ():
                n[f, t] += 1
                chains[f, t, k - i].append(i)
                places[f, t].add(i)
    top = Counter()
    for (f, _), x in places.items():
        top[f] = max(top[f], len(x))
    assert {(r.frag, r.tid): r.n for r in queries.seed_join(spark, DATA).collect()} == n
    got = {(r.frag, r.tid, r.diagonal): (r.seeds, r["first"], r["last"]) for r in queries.seed_chains(spark, DATA).collect()}
    assert got == {k: (len(x), min(x), max(x)) for k, x in chains.items()}
    assert {(r.frag, r.tid): r.hits for r in queries.sketch_map(spark, DATA).collect()} == {k: len(x) for k, x in places.items() if len(x) == top[k[0]]}
    assert {r.kmer: (r.n, r.targets) for r in queries.kmer_index(spark, DATA).collect()} == {k: (c, len(targets[k])) for k, c in count.items()}
