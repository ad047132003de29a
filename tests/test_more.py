"""Further operators on small tables."""

import pytest
from pyspark.sql import functions as F

from windrow.functions import sequences as sq
from windrow.operators import learn, metrics as m, selection as sel
from windrow.plans import evaluation, extras, registry, sequences
from windrow.streaming import live


def test_locate_and_contained(spark, tmp_path):
    files = spark.createDataFrame([("GCF_000000001.1", "/a"), ("GCA_000000002.1", "/b")], "accession string, path string")
    wanted = spark.createDataFrame([("GCF_000000001.1",), ("GCF_000000002.1",), ("GCF_000000003.1",)], "accession string")
    assert {r["accession"]: r["path"] for r in sel.locate(wanted, files).collect()} == {"GCF_000000001.1": "/a", "GCF_000000002.1": "/b", "GCF_000000003.1": None}
    rec = spark.createDataFrame([("x GCF_000000001.1 y",), ("GCA_000000009.2_seg",), ("clean",)], "header string")
    bad = spark.createDataFrame([("GCF_000000001.1",), ("GCA_000000009",)], "id string")
    assert [r["header"] for r in sel.drop_containing(rec, bad, "header", "id").collect()] == ["clean"]
    ranges = spark.createDataFrame([(0, 10, "short"), (10, 20, "long")], "low int, high int, name string")
    got = {r["v"]: r["name"] for r in sel.in_range(spark.createDataFrame([(10,), (11,), (21,), (None,)], "v int"), "v", ranges).collect()}
    assert got == {10: "short", 11: "long", 21: None, None: None}
    assert sel.first_existing(spark, [str(tmp_path / "no"), str(tmp_path)]) == str(tmp_path)


def test_multiclass_scores(spark):
    df = spark.createDataFrame([("k", 0, [0.7, 0.2, 0.1]), ("k", 1, [0.5, 0.3, 0.2]), ("k", 2, [0.2, 0.5, 0.3]), ("k", 0, [0.6, 0.3, 0.1])], "k string, y int, s array<double>")
    assert m.top_k_accuracy(df, ["k"], "y", "s", 1).first()["accuracy"] == 0.5 and m.top_k_accuracy(df, ["k"], "y", "s", 2).first()["accuracy"] == 1.0
    wide = df.withColumns({f"s{i}": F.col("s")[i] for i in range(3)})
    assert m.one_vs_rest_auc(wide, ["k"], "y", {i: f"s{i}" for i in range(3)}).first()["auc"] == pytest.approx((2 * 1.0 + 0.5 + 1.0) / 4)
    ml = spark.createDataFrame([("k", [1, 0], [0.9, 0.8]), ("k", [0, 1], [0.1, 0.7])], "k string, y array<int>, s array<double>")
    assert m.multilabel_f1_max(ml, ["k"], "y", "s").first()["f1_max"] == pytest.approx(0.8)
    per = m.multiclass(df.withColumn("g", F.lit(0)), ["k"], "y", "g").first()
    assert per["accuracy"] == 0.5 and per["mcc"] == 0 and per["weighted_precision"] == 0.25


def test_small_aggregates(spark):
    df = spark.createDataFrame([("a", 0.05, 10), ("a", 0.95, 30), ("a", 2.0, 10)], "k string, v double, n int")
    assert {(r["bin"], r["n"]) for r in m.histogram(df, ["k"], "v", 0.0, 1.0, 10).collect()} == {(0, 1), (9, 2)}
    r = m.running_loss(df, ["k"], "v", "n").first()
    assert r["tokens"] == 50 and r["loss"] == pytest.approx((0.5 + 28.5 + 20) / 50)
    t = spark.createDataFrame([([2, 100, 101, 3],), ([2, 300, 3],)], "ids array<int>")
    assert sorted(r["padded"] for r in sq.rectangular(t, "ids").collect()) == [[2, 100, 101, 3], [2, 300, 3, 0]]
    c = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "node string, component string")
    assert {r["node"]: r["cluster"] for r in learn.numbered_clusters(c).collect()} == {"a": 0, "b": 0, "c": 1}


def test_pivot_has_every_model(spark, sf):
    models = {r["model"] for r in spark.read.parquet(f"{sf}/predictions.parquet").select("model").distinct().collect()} - {None}
    assert len(models) == 5 and set(evaluation.q_pivot_f1(spark, sf).columns) == {"genome", *models}


def test_sessions_of_a_stream_in_several_steps(spark, sf, tmp_path, monkeypatch):
    """One file a trigger and rows in no order: nothing is too late."""
    monkeypatch.setattr(live, "FILES", 1)
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(5, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    got = extras.q_stream_sessions(spark, str(tmp_path))
    w = events.groupBy(F.session_window(F.col("ts").cast("timestamp"), "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    want = w.select(*(F.col(f"w.{c}").cast("timestamp_ntz").alias(c) for c in ("start", "end")), "user_id", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_silhouette_takes_every_query(spark, monkeypatch):
    df = spark.createDataFrame([(i, i % 3, [float(i % 7), float(i % 3) * 4 + i % 5]) for i in range(60)], "id bigint, label int, f array<double>")
    whole = sorted(map(tuple, learn.silhouette(df, "id", "f", "label", every=2).collect()))
    monkeypatch.setattr(learn, "MAX_QUERIES", 7)
    passes = sorted(map(tuple, learn.silhouette(df, "id", "f", "label", every=2).collect()))
    assert [r[:2] for r in passes] == [(i, i % 3) for i in range(0, 60, 2)]
    assert all(a[2:] == pytest.approx(b[2:]) for a, b in zip(passes, whole, strict=True))


def test_sequence_queries_meet_all_tables(spark, sf):
    queries = registry.queries()
    ids = {t: {r[0] for r in sequences.records(spark, sf, t).select("segment_id").collect()} for t in sequences.ALL}
    for name in ("q_kmer_tokens_all", "q_contiguous_segments_all", "q_sliding_windows_all", "q_kmer_frequencies_all"):
        got = {r[0] for r in queries[name](spark, sf).select("segment_id").distinct().collect()}
        assert all(got & of for of in ids.values()), name
    whole = set().union(*ids.values())
    assert {r["node"] for r in queries["q_sketch_clusters_all"](spark, sf).collect()} == whole
    near = queries["q_sketch_distances_all"](spark, sf).collect()
    assert any(r["a"] in ids["train"] or r["b"] in ids["train"] for r in near) and {x for r in near for x in (r["a"], r["b"])} <= whole
