from pyspark.sql import functions as F

from helixframe.functions import sequences as S
from helixframe.operators import tiling
from helixframe.sources import readers, sinks

LINE = "1035\ttig00000001\t98045\t539\t+\t261026\tm54113_160913_184949/5570667/0_1125\t4\t527\t-\t1125\t10,1:0,5,1:0,3,1:0,5,0:1,3\tEG2=8.2e-86\tE=6.6e-95"


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_alignment_line(spark, tmp_path):
    path = write(tmp_path, "a.tab", "# comment\n" + LINE + "\nbroken\tline\n" + "\t".join(LINE.split("\t")[:12]) + "\n" + LINE.replace("EG2=8.2e-86\tE=6.6e-95", "E=6.6e-95\tEG2=8.2e-86") + "\n")
    rows = readers.last_tab(spark, path).collect()
    assert len(rows) == 3
    r = rows[0]
    assert (r["score"], r["s1_name"], r["s1_start"], r["s1_matchlen"], r["s1_fwd"], r["s1_len"]) == (1035, "tig00000001", 98045, 539, True, 261026)
    assert "".join(f"{o['op']}{o['len']}" for o in r["ops"]) == "M10D1M5D1M3D1M5I1M3"
    assert (r["s2_fwd_start"], r["s2_fwd_end"]) == (594, 1121) and (r["eg2"], r["e"]) == (8.2e-86, 6.6e-95)
    assert (rows[1]["eg2"], rows[1]["e"]) == (2.0, 3.0) and (rows[2]["eg2"], rows[2]["e"]) == (8.2e-86, 6.6e-95)


def test_operations_are_taken_to_a_reference_length():
    stack = [("M", 10), ("I", 3), ("D", 4), ("M", 10), ("I", 5), ("M", 2), ("D", 3), ("M", 4)]
    assert tiling.take_reference(list(stack), 4) == (4, [("M", 4)])
    s = list(stack)
    assert tiling.take_reference(s, 14) == (16, [("M", 4), ("D", 3), ("M", 2), ("I", 5), ("M", 5)]) and s[-1] == ("M", 5)
    s = list(stack)
    assert tiling.take_reference(s, 5) == (4, [("M", 4), ("D", 1)]) and s[-1] == ("D", 2)


def test_sequence_formats(spark, tmp_path):
    fa = readers.fasta(spark, write(tmp_path, "a.fa", ">r1 some text\nACGT\nAC\n>r2\nGG\n>\nTT\n")).orderBy("id").collect()
    assert [tuple(r) for r in fa] == [("r1", "some text", "ACGTAC"), ("r2", None, "GG")]
    fq = readers.fastq_as_fasta(spark, write(tmp_path, "a.fq", "@q1 d\nACGT\n+\n!!!!\n@q2\nGG\n+\n@!\n")).orderBy("id").collect()
    assert [tuple(r) for r in fq] == [("q1", "d", "ACGT"), ("q2", None, "GG")]
    maf = readers.maf(spark, write(tmp_path, "a.maf", "# x\na score=1200\ns ref 5 4 + 100 AC-GT\ns read 0 5 + 50 ACTGT\n\na score=7\ns ref 9 1 + 100 A\ns r2 0 1 + 9 A\n\n")).orderBy("r_start").collect()
    assert [tuple(r) for r in maf] == [(1200.0, "ref", 5, "AC-GT", "read", "ACTGT"), (7.0, "ref", 9, "A", "r2", "A")]


def test_table_formats(spark, tmp_path):
    assert [tuple(r) for r in readers.paf(spark, write(tmp_path, "a.paf", "q\t100\t5\t90\t+\tx\nbad\n")).collect()] == [("q", 100, 5, 90)]
    sam = readers.sam(spark, write(tmp_path, "a.sam", "@HD\nq\t16\tr\t11\t60\t5M\t*\t0\t0\tACGTA\t*\nq\t256\tr\t1\t60\t5M\t*\t0\t0\tA\t*\nz\t0\tr\t1\t20\t5M\t*\t0\t0\tA\t*\n")).collect()
    assert [(r["qname"], r["pos"], r["is_reverse"]) for r in sam] == [("q", 10, True)]
    assert [tuple(r) for r in readers.gff(spark, write(tmp_path, "a.gff", "#c\nchr\ts\tgene\t10\t90\t.\tname\nx\ty\n")).collect()] == [("chr", 10, 90, "name")]
    assert [tuple(r) for r in readers.assignments(spark, write(tmp_path, "a.tsv", "1\tr1\n-\tr2\n2\tr3\tx\n")).collect()] == [(1, "r1"), (2, "r3")]
    assert sorted(tuple(r) for r in readers.haplotags(spark, write(tmp_path, "h.tsv", "read\thaplotype\tphase_set\na\tH2\t1\nb\tnone\tnone\n")).collect()) == [("a", 2), ("b", 0)]
    assert sorted(tuple(r) for r in readers.cluster_list(spark, write(tmp_path, "c.txt", "1 5\n\n7\n")).collect()) == [(0, 1), (0, 5), (2, 7)]
    assert [tuple(r) for r in readers.name_map(spark, write(tmp_path, "m.tsv", "a\tb\n")).collect()] == [("a", "b")]
    assert [tuple(r) for r in readers.peak_table(spark, write(tmp_path, "p.tsv", "contig\tstart\nc\t5\n")).collect()] == [("c", 5)]
    (tmp_path / "3").mkdir()
    write(tmp_path, "3/assembly.fasta", ">u\nAC\n")
    assert [tuple(r) for r in readers.assemblies(spark, f"{tmp_path}/*/assembly.fasta").collect()] == [(3, "u", "AC")]


def test_sequence_functions(spark):
    r = spark.createDataFrame([("acgTN",)], "s string").select(S.reverse_complement(F.col("s")), S.kmer_index(F.lit("ACGT"))).first()
    assert tuple(r) == ("NACGT", 27)
    assert S.kmer_entropy_of("AAAAAAAA") == 0.0 and S.kmer_entropy_of("ACGT") is None
    assert abs(S.kmer_entropy_of("ACGTACG" * 30, 2) - 2.236) < 0.02 and S.kmer_entropy_of("ACGTACGT", 3, compat=True) is not None


def test_sinks(spark, tmp_path):
    reads = spark.createDataFrame([("a", "d", "AC", 0), ("b", None, "GG", None)], "id string, desc string, seq string, cluster int")
    sinks.fasta_by_cluster(reads, f"{tmp_path}/out")
    got = sorted((r["cluster"], r["id"], r["seq"]) for r in readers.fasta(spark, f"{tmp_path}/out/cluster=0").withColumn("cluster", F.lit(0)).union(readers.fasta(spark, f"{tmp_path}/out/cluster=1").withColumn("cluster", F.lit(1))).collect())
    assert got == [(0, "a", "AC"), (1, "b", "GG")]
    assert sorted(r["desc"] for r in sinks.read_list(reads).collect()) == ["NoDesc", "d"]


def test_tiling(spark):
    contig = "".join("ACGT"[(i * i + i // 7) % 4] for i in range(2000))
    turned = contig[300:1300][::-1].translate(str.maketrans("ACGT", "TGCA"))
    reads = spark.createDataFrame([("f", "TTTT" + contig[250:1250] + "GG"), ("r", turned), ("none", "ACGT")], "id string, seq string")
    lines = ["\t".join(map(str, [900, "c", 250, 1000, "+", 2000, "f", 4, 1000, "+", 1006, "1000"])), "\t".join(map(str, [900, "c", 300, 1000, "+", 2000, "r", 0, 1000, "-", 1000, "1000"]))]
    alns = readers.parse_last_tab(spark.createDataFrame([(x,) for x in lines], "value string"))
    out = tiling.tile(reads, alns, spark.createDataFrame([(0, "c")], "contig int, name string"))
    rows = sorted(out.collect(), key=lambda r: (r["read_id"], r["pos"]))
    f = [r for r in rows if r["read_id"] == "f"]
    assert [r["unit"] for r in f if not r["is_gap"]] == list(range(3, 12)) and all(r["bases"] == contig[r["unit"] * 100 : r["unit"] * 100 + 100] for r in f if not r["is_gap"])
    back = {r["read_id"]: r["seq"] for r in tiling.read_back(out).collect()}
    assert back == {r["id"]: r["seq"] for r in reads.collect()}
    rev = {(r["unit"], r["bases"]) for r in tiling.forward_bases(out).filter("read_id = 'r'").collect()}
    assert len(rev) >= 8 and all(b == contig[u * 100 : u * 100 + 100] for u, b in rev)
    none = [r for r in rows if r["read_id"] == "none"]
    assert len(none) == 1 and none[0]["is_gap"] and none[0]["gap_lo"] is None


def test_json_tables_and_checkpoints(spark, tmp_path):
    from helixframe.sources import readers, sinks

    (tmp_path / "a.json").write_text('[{"id": 1, "n": 2.5},\n {"id": 2, "n": null}]')
    assert sorted(map(tuple, readers.json_records(spark, str(tmp_path / "a.json"), "id long, n double").collect())) == [(1, 2.5), (2, None)]
    (tmp_path / "t.tsv").write_text("Pos\tRate\n1\t0.5\n2\tNA\n")
    assert sorted(map(tuple, readers.table(spark, str(tmp_path / "t.tsv"), "Pos long, Rate double").collect())) == [(1, 0.5), (2, None)]
    made = []
    make = lambda: made.append(1) or spark.range(5)
    assert sinks.resumed(spark, f"{tmp_path}/kept", make).count() == sinks.resumed(spark, f"{tmp_path}/kept", make).count() == 5 and len(made) == 1


def test_contigs_chunks_and_metrics(spark):
    from helixframe.sources import sinks

    contigs = spark.createDataFrame([(3, "AC", 5), (3, "G", 1), (4, "T", 0)], "index int, seq string, ord int")
    assert sorted(r["value"] for r in sinks.fasta(sinks.renamed_contigs(contigs)).collect()) == [">3_0\nG", ">3_1\nAC", ">4_0\nT"]
    chunks = spark.createDataFrame([(1, 0, True, 0, 0, 77), (1, 1, False, 2, 9, 100)], "read_id long, pos long, is_gap boolean, contig long, unit long, n_bases long")
    assert sinks.encoded_reads(chunks).toJSON().collect() == ['{"id":1,"seq":[{"G":77},{"E":[2,9]}]}']
    assert sorted(map(tuple, sinks.metrics(spark.createDataFrame([(0.5, 3)], "acc double, n int"), "RESULT", ["acc", "n"]).collect())) == [("RESULT", "acc", 0.5), ("RESULT", "n", 3.0)]
    reps = spark.createDataFrame([(0, 5, 9, 1), (1, 3, 4, 1)], "contig long, rs long, re long, ord long")
    assert sinks.repeats_json(reps).first()[0] == '{"reps":[{"contig":0,"start":5,"end":9},{"contig":1,"start":3,"end":4}]}'
    nodes, edges = spark.createDataFrame([(1, 2, "AC")], "node long, occ long, seq string"), spark.createDataFrame([], "a long, a_tail boolean, b long, b_tail boolean, occ long")
    groups = spark.createDataFrame([("g", 2), ("g", 1)], "name string, node long")
    assert [r["value"] for r in sinks.gfa(nodes, edges, groups).collect()] == ["S\t1\t2\tAC", "U\tg\t1 2"]
