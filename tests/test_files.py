"""Readers and writers, there and back."""

import gzip

import pytest

from strandtally.operators import classes
from strandtally.sources import readers, writers


def put(path, text):
    path.write_text(text)
    return str(path)


def test_fastq_pairs(spark, tmp_path):
    a = put(tmp_path / "a_1.fq", "".join(f"@r{i}/1 x\nACGT\n+\nIIII\n" for i in range(20)))
    b = tmp_path / "a_2.fq.gz"
    b.write_bytes(gzip.compress("".join(f"@r{i}/2\nTTTT\n+\nIIII\n" for i in range(20)).encode()))
    pairs = readers.paired_reads(readers.read_fastq(spark, a), readers.read_fastq(spark, str(b)), [("a_1.fq", "a_2.fq.gz")])
    got = pairs.orderBy("rec").collect()
    assert len(got) == 20 and got[3].name == "r3/1" and got[3].seq2 == "TTTT"


def test_fasta(spark, tmp_path):
    p = put(tmp_path / "t.fa", ">a|1 first\nACG\nTNN\n>b\nGGG\n")
    got = {r.name: r.seq for r in readers.read_fasta(spark, p, bar_ends_name=True).collect()}
    assert got == {"a": "ACGTNN", "b": "GGG"}
    t = readers.read_fasta(spark, p)
    s = t.select(readers.only_bases(t["seq"], t["name"]).alias("s")).collect()
    assert all(set(r.s) <= set("ACGT") for r in s) and readers.duplicate_names(t).count() == 0


def test_checks():
    readers.check_sources(["a.fq"], ["b.fq"])
    for bad in (([],), (["a.fq"], []), (["a.txt"],)):
        with pytest.raises(ValueError):
            readers.check_sources(*bad)


def test_sam(spark, tmp_path):
    head = "@SQ\tSN:t1\tLN:100\n@SQ\tSN:d1\tLN:50\tDS:D\n@PG\tID:x\tPN:Bowtie2\n"
    line = lambda n, f, p, q: f"{n}\t{f}\tt1\t{p}\t60\t4M\t=\t{q}\t20\tACGT\tIIII\tAS:i:-3\n"
    p = put(tmp_path / "x.sam", head + line("r", 0x1 | 0x2 | 0x40, 5, 20) + line("r", 0x1 | 0x2 | 0x80 | 0x10, 20, 5) + line("u", 0x4, 0, 0))
    sam = readers.read_sam(spark, p)
    assert sam.count() == 3 and readers.usable_alignments(sam).count() == 2
    pair = readers.sam_pairs(sam).collect()
    assert len(pair) == 1 and pair[0].mate_pos == 20 and not pair[0].mate_fwd and pair[0].score == -3
    assert [r.kind for r in readers.alignment_kind(sam).orderBy("line").collect()] == ["paired", "paired", "unmapped"]
    header = readers.read_sam_header(spark, p)
    assert [(r.name, r.decoy) for r in header.orderBy("ord").collect()] == [("t1", False), ("d1", True)] and readers.headers_agree(header)
    assert readers.aligner(spark, p).first().program == "bowtie2"
    assert writers.sam_lines(sam.filter("qname = 'u'")).first().value.startswith("u\t4\tt1\t0")


def test_class_file(spark, tmp_path):
    p = put(tmp_path / "eq.txt", "2\n2\na\nb\n2\t0\t1\t0.25\t0.75\t7\n1\t1\t1.0\t3\nb\t80.5\n")
    targets, counts, members = readers.read_classes(spark, p)
    assert {r.name: r.eff_len for r in targets.collect()} == {"a": 100.0, "b": 80.5}
    assert {r.class_id: r.n for r in counts.collect()} == {0: 7, 1: 3}
    assert sorted((r.class_id, r.tid, r.w) for r in members.collect()) == [(0, 0, 0.25), (0, 1, 0.75), (1, 1, 1.0)]


def test_class_writer(spark, tmp_path):
    counts = spark.createDataFrame([("0,1|3,1", 2), ("0,1|2,2", 3), ("1|5", 4)], "key string, n long")
    writers.write_simple_classes(counts, spark.createDataFrame([(0, "a"), (1, "b")], "tid int, name string"), str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out/classes")).collect()) == ["1\t1\t4", "2\t0\t1\t5"]
    assert classes.collapse(counts).count() == 2


def test_gene_maps(spark, tmp_path):
    p = put(tmp_path / "m.tsv", "t1 g1\nt2\tg2\nt1 g9\n")
    assert {r.name: r.gene for r in readers.read_gene_map(spark, p).collect()} == {"t1": "g1", "t2": "g2"}
    g = put(tmp_path / "m.gtf", '#x\nc\ts\ttranscript\t1\t2\t.\t+\t.\tgene_id "g1"; transcript_id "t1";\nc\ts\texon\t1\t2\t.\t+\t.\tgene_id "g3"; transcript_id "t3";\n')
    assert [(r.name, r.gene) for r in readers.read_gtf(spark, g).collect()] == [("t1", "g1")]


def test_abundance_round_trip(spark, tmp_path):
    t = spark.createDataFrame([("a", 10.0, 9.5, 1.5, 2.0)], "name string, length double, effective_length double, tpm double, num_reads double")
    writers.write_tsv(t, str(tmp_path / "s1"))
    got = readers.read_abundances(spark, str(tmp_path / "s1")).first()
    assert (got["sample"], got["name"], got["tpm"]) == ("s1", "a", 1.5)
    writers.write_json({"k": 31}, spark, str(tmp_path / "meta"))
    assert spark.read.json(str(tmp_path / "meta")).first().k == 31
    names = readers.read_names(spark, put(tmp_path / "names", "a b\nc\n"))
    assert readers.flag_targets(t.select("name"), names, "aux").first().aux
