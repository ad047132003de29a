"""Sources and sinks on small files."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrow.sources import fasta, tables, tools


@pytest.fixture()
def two(tmp_path):
    (tmp_path / "a.fa").write_text(">test1 test sequence 1\nAT\n\nGC\n>test2 test sequence 2\r\ncgta\r\n")
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">z\nACGTAC\n>y\nACG\n>x\nTTTTTT\n")
    return tmp_path


def test_fasta(spark, two):
    r = fasta.read_fasta(spark, str(two / "a.fa"))
    assert [(x["seq_id"], x["description"], x["sequence"]) for x in r.orderBy("seq_id").collect()] == [("test1", "test sequence 1", "ATGC"), ("test2", "test sequence 2", "CGTA")]
    both = fasta.both_strands(r).orderBy("seq_id", "orientation").collect()
    assert [x["sequence"] for x in both] == ["ATGC", "GCAT", "CGTA", "TACG"]
    z = fasta.read_fasta(spark, str(two / "b.fa.gz"))
    assert fasta.longest_per_file(z).first()["seq_id"] == "z"
    assert sorted(x["contig_id"] for x in fasta.headers(spark, str(two / "b.fa.gz")).collect()) == ["x", "y", "z"]
    g = fasta.genome_lengths(spark, str(two / "b.fa.gz")).first()
    assert (g["contigs"], g["length"]) == (3, 15)
    assert fasta.valid_alphabet(r).filter("valid").count() == 2
    assert fasta.read_fasta(spark, str(two / "a.fa"), whole_header=True).filter("seq_id = 'test1 test sequence 1'").count() == 1


def test_fasta_round_trip_and_chunks(spark, two, tmp_path):
    r = fasta.read_fasta(spark, str(two / "b.fa.gz"))
    fasta.write_fasta(r, str(tmp_path / "out"), width=4)
    back = fasta.read_fasta(spark, str(tmp_path / "out"))
    assert {(x["seq_id"], x["sequence"]) for x in back.collect()} == {(x["seq_id"], x["sequence"]) for x in r.collect()}
    c = {x["seq_id"]: x["chunk"] for x in fasta.chunk_numbers(r, "seq_id", 18).collect()}
    assert c == {"x": 0, "y": 0, "z": 1}
    twice = fasta.last_per_id(r.unionByName(r.filter("seq_id = 'z'").withColumn("source_file", F.lit("zzz")).withColumn("sequence", F.lit("A"))))
    assert twice.filter("seq_id = 'z'").first()["sequence"] == "A"
    wanted = spark.createDataFrame([("y.3",)], "accession string")
    assert [x["seq_id"] for x in fasta.only_accessions(r, wanted).collect()] == ["y"]
    iv = spark.createDataFrame([("z", 1, 3), ("z", 5, 9)], "seq_id string, start bigint, end bigint")
    assert sorted(x["sequence"] for x in fasta.fetch(iv, r).collect()) == ["C", "CG"]
    assert sorted(x["sequence"] for x in fasta.fetch(iv, r, 4).collect()) == ["ACGT", "GTAC"]


def test_delimited_with_bad_rows(spark, tmp_path):
    p = tmp_path / "hits.tsv"
    p.write_text("q1\ts1\t99.5\t300\t1\t0\t1\t300\t1\t300\t1e-9\t500\nbroken\trow\nq2\ts2\tx\t300\t1\t0\t1\t300\t1\t300\t1e-9\t500\n\n")
    good, bad = tables.read_delimited(spark, str(p), tables.BLAST_STANDARD)
    assert [r["qseqid"] for r in good.collect()] == ["q1"] and bad.count() == 2
    (tmp_path / "empty.tsv").write_text("")
    assert tables.read_delimited(spark, str(tmp_path / "empty.tsv"), tables.BLAST_FRAGMENTS)[0].isEmpty()
    (tmp_path / "m.tsv").write_text("#q\tr\td\tp\ts\n/x/A.fna.gz\t/x/B.fa\t0.02\t0\t9/10\n")
    assert tuple(tables.read_mash(spark, str(tmp_path / "m.tsv")).first()) == ("A", "B", 0.02)


def test_features(spark, tmp_path):
    (tmp_path / "g.gff").write_text("##gff\nc1\tp\tCDS\t1\t9\t.\t+\t0\tID=a;Product=tail;locus_tag=L_1;Note=n\nc1\tp\tgene\t1\t9\t.\t+\t.\tID=b\n")
    r = tables.read_gff(spark, str(tmp_path / "g.gff")).first()
    assert (r["id"], r["product"], r["note"], r["locus_tag"], r["start"]) == ("a", "tail", "n", "L_1", 1)
    (tmp_path / "b.json").write_text(json.dumps({"features": [{"type": "cds", "locus": "L", "product": "p", "psc": {"cog_category": "K", "cog_id": "COG1"}}, {"type": "trna"}]}))
    b = tables.read_bakta(spark, str(tmp_path / "b.json")).collect()
    assert len(b) == 1 and b[0]["cog_category"] == "K"


def test_metrics_and_lists(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"simple_metrics": {"f1": 0.5}}))
    (tmp_path / "two.json").write_text(json.dumps({"f1": 0.25, "mcc": 0.1}))
    (tmp_path / "all_summary.json").write_text(json.dumps({"f1": 0.9}))
    assert sorted(r["f1"] for r in tables.read_metrics(spark, str(tmp_path / "*.json")).collect()) == [0.25, 0.5]
    (tmp_path / "l.txt").write_text("A extra\n\n  B\n")
    assert [r[0] for r in tables.read_lines(spark, str(tmp_path / "l.txt")).collect()] == ["A", "B"]
    (tmp_path / "c.tsv").write_text("genome\tcluster\ng1\t0\ng2\t0\ng3\t1\n")
    assert [(r["genome"], r["cluster"]) for r in tables.read_clusters(spark, str(tmp_path / "c.tsv")).orderBy("ordinal").collect()] == [("g1", 0), ("g2", 0), ("g3", 1)]


def test_folders(spark, tmp_path):
    for model in ("m1", "_old"):
        at = tmp_path / "runs" / model / "cat" / "2k"
        at.mkdir(parents=True)
        (at / "GCF_1.1_predictions.csv").write_text("segment_id,seq_id,label,start,end,prob_0,prob_1,pred_label\ns1,c,1.0,0,10,0.1,0.9,1\n")
    r = tables.read_predictions(spark, str(tmp_path / "runs")).collect()
    assert len(r) == 1 and (r[0]["model"], r[0]["category"], r[0]["window"], r[0]["input_file"]) == ("m1", "cat", "2k", "GCF_1.1")
    for label in ("neg", "pos"):
        at = tmp_path / "lab" / "train" / label
        at.mkdir(parents=True)
        (at / "x.txt").write_text("ACGT")
    assert {(r["label_name"], r["label"]) for r in tables.read_label_folders(spark, str(tmp_path / "lab")).collect()} == {("neg", 0), ("pos", 1)}
    (tmp_path / "s").mkdir()
    for n in ("train", "val", "test"):
        (tmp_path / "s" / f"{n}.csv").write_text("segment_id,sequence,label\na,ACGT,1\n")
    assert {r["split"] for r in tables.read_splits(spark, str(tmp_path / "s"), "segment_id string, sequence string, label int").collect()} == {"train", "dev", "test"}
    with pytest.raises(FileNotFoundError):
        tables.read_splits(spark, str(tmp_path / "lab"), "a string")


def test_checks(spark):
    df = spark.createDataFrame([(1, 5, 8), (2, 6, 9), (3, 6, 10), (4, 7, None)], "A int, B int, C int")
    assert [tables.is_primary_key(df, c) for c in "ABC"] == [True, False, False]
    with pytest.raises(ValueError, match=r"\['D'\]"):
        tables.is_primary_key(df, "D")
    tables.require_columns(df, [])


def test_arrays_and_sinks(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(4.0))
    np.save(tmp_path / "b.npy", np.ones((2, 3)))
    assert sorted(r["values"] for r in tables.read_arrays(spark, str(tmp_path / "*.npy"), 3).collect()) == [[0, 1, 2], [1, 1, 0]]
    df = spark.createDataFrame([("c", 5, 9, 0.5), ("c", 1, 3, None)], "seq_id string, start bigint, end bigint, score double")
    tables.write_delimited(df.coalesce(1), str(tmp_path / "t"), digits=2)
    assert sorted(spark.read.text(str(tmp_path / "t")).toPandas()["value"])[-1] == "seq_id,start,end,score"
    tables.write_bed(df, str(tmp_path / "bed"), ["seq_id"])
    assert sorted(r[0].split("\t")[3] for r in spark.read.text(str(tmp_path / "bed")).collect()) == ["region_1", "region_2"]
    tables.write_documents(df.withColumn("k", F.col("start")), str(tmp_path / "docs"), "k")
    assert json.loads(spark.read.text(str(tmp_path / "docs" / "k=5")).first()[0])["end"] == 9
    assert sorted(r["chunk"] for r in tables.equal_chunks(df, "start", 2).collect()) == [1, 2]


def test_tools(spark):
    s = spark.createDataFrame([("a___1", "Phage", "0.9"), ("b___0", "Bacteria", "0.2")], "n string, c string, s string")
    assert [tuple(r) for r in tools.seeker(s).orderBy("seq_id").collect()] == [("a___1", 1, 1, 0.9, 0.1, "Seeker"), ("b___0", 0, 0, 0.2, 0.8, "Seeker")]
    m = spark.createDataFrame([("a", "phage", "91.5", "1", "2", "3"), ("b", "not processed", "not processed", "1", "2", "3")], "id string, class string, ani string, `merged coverage [%]` string, `number of hits` string, `size[bp]` string")
    assert [tuple(r)[2:5] for r in tools.metaphinder(m).collect()] == [(1, 91.5, 8.5)]
    g = spark.createDataFrame([("a", 0.1, 0.2, 0.7), ("b", 0.5, 0.4, 0.1)], "seq_name string, chromosome_score double, plasmid_score double, virus_score double")
    assert [(r["pred"], r["other_score"]) for r in tools.genomad(g, g.filter("seq_name = 'a'")).orderBy("seq_id").collect()] == [(1, 0.3), (0, 0.9)]
    v = spark.createDataFrame([("a||full", 0.9, 0.1, "dsDNAphage"), ("b||x", None, 0.1, "ssDNA"), ("c|", 0.1, 0.2, "NCLDV")], "seqname string, dsDNAphage double, ssDNA double, max_score_group string")
    assert [(r["seq_id"], r["pred"]) for r in tools.virsorter(v).collect()] == [("a", 1)]
    d = spark.createDataFrame([("a___1", 10, 0.91234, 0.01)], "name string, len int, score double, pvalue double")
    assert tuple(tools.deepvirfinder(d).first())[1:5] == (1, 1, 0.912, 0.088)


def test_headers_with_marks_and_carriage_returns(spark, tmp_path):
    (tmp_path / "m.fa").write_text(">a 5 prime ->3 prime end\nACGT\nAC\n>b >c\r\nGG\r\nTT\r\n\n>d\n")
    got = {(r["seq_id"], r["description"], r["sequence"]) for r in fasta.read_fasta(spark, str(tmp_path / "m.fa")).collect()}
    assert got == {("a", "5 prime ->3 prime end", "ACGTAC"), ("b", ">c", "GGTT"), ("d", "", "")}
    assert fasta.first_records(spark, str(tmp_path / "m.fa")).select("seq_id", "length", "gc").first() == ("a", 6, 0.5)


def test_prediction_files_with_other_columns(spark, tmp_path):
    at = tmp_path / "m" / "cat" / "2k"
    at.mkdir(parents=True)
    (at / "a_predictions.csv").write_text("segment_id,prob_0,prob_1,pred_label\ns1,0.1,0.9,1\n")
    (at / "b_predictions.csv").write_text('pred_label,sequence,prob_1,prob_0,seq_id,end,start\n0,"AC,GT",0.2,0.8,c1,20,10\n')
    (at / "notes.csv").write_text("x\n1\n")
    got = {r["input_file"]: r for r in tables.read_predictions(spark, str(tmp_path)).collect()}
    assert set(got) == {"a", "b"} and got["a"]["seq_id"] is None and got["a"]["prob_1"] == "0.9"
    assert (got["b"]["segment_id"], got["b"]["seq_id"], got["b"]["start"], got["b"]["end"], got["b"]["pred_label"]) == (None, "c1", "10", "20", "0")
    assert tables.read_predictions(spark, str(tmp_path / "m" / "cat")).columns == got["a"].__fields__


def test_chunks_follow_the_greedy_rule(spark, monkeypatch):
    monkeypatch.setattr(fasta, "SPAN", 3)
    sizes = [5, 40, 1, 1, 30, 90, 2, 2, 60, 7, 7, 7, 7, 100, 3]
    df = spark.createDataFrame([(f"r{i:02d}", "A" * n) for i, n in enumerate(sizes)], "seq_id string, sequence string")
    want, chunk, filled = [], 0, 0
    for n in sizes:
        if filled and filled + n + 6 > 60:
            chunk, filled = chunk + 1, 0
        filled += n + 6
        want.append(chunk)
    got = [r["chunk"] for r in fasta.chunk_numbers(df, "seq_id", 60).orderBy("seq_id").collect()]
    assert got == want
