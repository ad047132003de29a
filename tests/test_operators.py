"""Operators against plain Python on small random tables, and their edge cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrow.operators import graph, intervals as iv, learn, metrics as m, predictions as pr, sampling as sm, selection as sel, signal as sg
from windrow.plans import pipelines as pl
from windrow.storage import materialize, shared_dir


def merged(rows):
    out = []
    for s, e in sorted(rows):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def test_periods_and_gaps(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(600):
        s = rng.randrange(-50, 3000)
        rows.append((rng.choice("abc"), s, s + rng.choice([0, 1, 5, 40, 300]) * rng.choice([1, 1, -1])))
    df = spark.createDataFrame([*rows, (None, 1, 2), ("a", None, 2), ("z", 5, 5)], "k string, start bigint, end bigint")
    got = {}
    for r in iv.periods_and_gaps(df, ["k"], block=64).collect():
        got.setdefault((r["kind"], r["k"]), set()).add((r["start"], r["end"]))
    for k in "abc":
        want = merged([(min(s, e), max(s, e)) for x, s, e in rows if x == k and s != e])
        assert got["period", k] == set(want)
        assert got.get(("gap", k), set()) == {(a[1], b[0]) for a, b in zip(want, want[1:])}
    assert not any(k == "z" for _, k in got)
    assert iv.periods_and_gaps(df.limit(0), ["k"]).isEmpty()


def test_hot_contig_and_clashing_columns(spark):
    rows = [("GCF_123456789.1", " nz_1 ", i * 10, i * 10 + 10) for i in range(3000)]
    df = spark.createDataFrame(rows, "assembly string, ncbi_id string, start bigint, end bigint").withColumns({"_s": F.lit("x"), "kind": F.lit("y"), "session_window": F.lit(1)})
    got = iv.prophage_periods(df.unionByName(df)).collect()
    assert [tuple(r) for r in got] == [("period", "123456789", "NZ_1", 0, 30_000)]


def test_overlap_join_and_base_confusion(spark):
    rng = random.Random(2)
    def table(n):
        return [(rng.choice("ab"), s, s + rng.randrange(1, 60)) for s in (rng.randrange(0, 400) for _ in range(n))]
    a, b = table(60), table(60)
    schema = "k string, start bigint, end bigint"
    A, B = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    for least in (1, 20):
        got = sorted(tuple(r) for r in iv.overlap_join(A, B, ["k"], least, bucket=37).select("k", "l_start", "l_end", "r_start", "r_end").collect())
        assert got == sorted((k, s, e, t, f) for k, s, e in a for q, t, f in b if k == q and min(e, f) - max(s, t) >= least)
    with pytest.raises(ValueError):
        iv.overlap_join(A, B, ["k"], 0)
    lengths = spark.createDataFrame([("a", 350), ("b", 500), ("c", 9)], "k string, length bigint")
    for r in iv.base_confusion(A, B, lengths, ["k"]).collect():
        n = {"a": 350, "b": 500, "c": 9}[r["k"]]
        x, y = ({i for k, s, e in t if k == r["k"] for i in range(s, min(e, n))} for t in (a, b))
        assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (len(x & y), len(y - x), len(x - y), n - len(x | y))


def test_components(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(180)] + [(f"p{i}", f"p{i + 1}") for i in range(200)] + [("hub", f"h{i}") for i in range(300)] + [("solo", "solo"), (None, "x"), ("y", None)]
    parent = {}
    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a and b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {x: find(x) for x in parent} and "x" not in got
    assert graph.connected_components(spark.createDataFrame([], "src string, dst string")).isEmpty()


def test_auc_is_rank_based(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(2), rng.choice([0.1, 0.2, 0.35, 0.5, 0.9])) for _ in range(200)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame([("m", *r) for r in rows] + [("one", 1, 0.5), ("m", None, 0.1), ("m", 1, None)], "k string, label int, score double")
    got = {r["k"]: r["auc"] for r in m.roc_auc(df, ["k"]).collect()}
    assert got["m"] == pytest.approx(want) and got["one"] is None
    assert {r["k"]: r["auc"] for r in m.trapezoid_auc(df.filter("k = 'm'"), ["k"]).collect()}["m"] == pytest.approx(want)


def test_rates_of_nothing(spark):
    r = m.rates(spark.createDataFrame([(0, 0, 0, 0)], "tp bigint, tn bigint, fp bigint, fn bigint")).first()
    assert r["precision"] is None and r["f1"] is None and r["mcc"] == 0
    big = m.rates(spark.createDataFrame([(10**10, 10**10, 10**9, 10**9)], "tp bigint, tn bigint, fp bigint, fn bigint")).first()
    assert 0 < big["mcc"] < 1


def test_sweep_and_best(spark):
    df = spark.createDataFrame([("k", y, s) for y, s in [(1, 0.29), (1, 0.57), (0, 0.28), (0, 0.1), (1, 1.0), (0, 0.0)]], "k string, label int, score double")
    sweep = {round(r["threshold"], 2): r for r in m.threshold_sweep(df, ["k"]).collect()}
    assert (sweep[0.29]["tp"], sweep[0.29]["fp"]) == (3, 0) and (sweep[0.57]["tp"], sweep[1.0]["tp"], sweep[0.0]["fp"]) == (2, 1, 3)
    best = m.optimal_thresholds(m.threshold_sweep(df, ["k"]), ["k"]).first()
    assert best["best_f1"] == pytest.approx(0.29)


def test_chi_square_p():
    assert m.chi_square_p(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert m.chi_square_p(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert m.chi_square_p(0, 3) == 1.0


def test_regions_with_nested_windows(spark):
    df = spark.createDataFrame([("g", 0, 10_000, 0.9), ("g", 1000, 2000, 0.8), ("g", 4000, 5000, 0.7), ("g", 30_000, 31_000, 0.6)], "k string, start bigint, end bigint, score double")
    assert [(r["start"], r["end"]) for r in sg.regions(df, ["k"], 100).orderBy("start").collect()] == [(0, 10_000), (30_000, 31_000)]
    assert [(r["start"], r["end"]) for r in sg.regions(df, ["k"], 100, running=False).orderBy("start").collect()] == [(0, 2000), (4000, 5000), (30_000, 31_000)]
    assert sg.regions(df, ["k"], 100, 5000).count() == 1


def test_collapse_against_masks(spark):
    rng = random.Random(5)
    rows = [("g", f"s{i}", s, s + rng.choice([1000, 2000, 2500]), rng.random(), rng.randrange(2), rng.randrange(2)) for i, s in enumerate(range(300, 12_000, 700))]
    got = {(r["start"], r["end"]): r for r in sg.collapse(spark.createDataFrame(rows, "k string, segment_id string, start bigint, end bigint, score double, pred int, label int"), ["k"]).collect()}
    lo, hi = min(r[2] for r in rows), max(r[3] for r in rows)
    want = {}
    for b in range(lo, hi, 1000):
        e = min(b + 1000, hi)
        mine = [r for r in rows if r[2] <= b and r[3] >= e]
        if mine:
            want[b, e] = (np.mean([r[4] for r in mine]), int(2 * sum(r[5] for r in mine) > len(mine)), mine[0][6])
    assert set(got) == set(want)
    for k, (score, pred, label) in want.items():
        assert got[k]["score"] == pytest.approx(score) and (got[k]["pred"], got[k]["label"]) == (pred, label)


def test_smoothing():
    v = np.array([0.0, 1.0, 0.0])
    assert sg.ewm_both_ways(v, 1) is v
    there = [0, 0.5, 0.25]
    assert sg.ewm_both_ways(v, 3) == pytest.approx([(a + b) / 2 for a, b in zip(there, there[::-1])])


def test_constant_scores(spark):
    df = spark.createDataFrame([("g", i, 0.5) for i in range(4)], "k string, i int, score double")
    for method in sg.NORMALS:
        assert all(r["normal"] in (0.0, 0.625) for r in sg.normalize(df, ["k"], "score", method).collect())
    with pytest.raises(ValueError):
        sg.normalize(df, ["k"], "score", "percentile")


def test_normalized_predictions_of_other_names(spark):
    df = spark.createDataFrame([("s", "1.0", float("nan"), None), ("s", "1.0", 0.7, None), ("t", "x", 0.2, "1"), (None, "0", 0.1, "1")], "sequence_id string, true_label string, prob_class_1 double, predicted_label string")
    got = {r["segment_id"]: r for r in pr.normalize_predictions(df).collect()}
    assert set(got) == {"s", "t"} and (got["s"]["label"], got["s"]["pred"]) == (1, 1) and (got["t"]["label"], got["t"]["pred"]) == (None, 1)
    bare = pr.normalize_predictions(spark.createDataFrame([("a",)], "id string")).first()
    assert (bare["score"], bare["pred"], bare["label"]) == (0.5, 1, None)


def test_sampling(spark):
    starts = sm.nonoverlapping_starts(10_000, 4, 2000, "k", 1)
    assert starts == sm.nonoverlapping_starts(10_000, 4, 2000, "k", 1) and all(b - a >= 2000 for a, b in zip(starts, starts[1:])) and max(starts) <= 8000
    assert sm.nonoverlapping_starts(100, 3, 2000, "k", 1) == []
    for repair in ("largest", "smallest"):
        got = sm.proportional_allocation({"a": 1000, "b": 10, "c": 1, "d": 0}, 20, repair)
        assert sum(got.values()) == 20 and min(got.values()) == 1 and set(got) == {"a", "b", "c"} and got["c"] == 1
    assert sum(sm.proportional_allocation({"a": 2, "b": 1}, 10).values()) == 3
    df = spark.createDataFrame([(f"g{i}", i * 100) for i in range(97)], "accession string, length bigint")
    split = {r["accession"]: r["split"] for r in sm.group_split(df.unionByName(df), "accession", 1).collect()}
    assert [list(split.values()).count(s) for s in ("train", "dev", "test")] == [77, 9, 11]
    cov = sm.coverage_segments(df, "accession", "length", 10, 100, 10, 3)
    bases = cov.agg(F.sum(F.col("end") - F.col("start"))).first()[0]
    total = sum(i * 100 for i in range(97))
    assert 5 * total < bases < 15 * total and cov.filter("accession = 'g0'").isEmpty()
    assert {r["n"] for r in sm.even_allocation(df, "accession", 100, 1).collect()} == {1, 2}
    ids = F.array(*map(F.lit, [2, *range(5, 205), 3]))
    r = spark.range(1).select(sm.masked(ids, F.lit("k"), 1).alias("m")).first()["m"]
    chosen = [i for i, x in enumerate(r["labels"]) if x != -100]
    assert 10 < len(chosen) < 60 and all(r["ids"][i] == v for i, v in enumerate([2, *range(5, 205), 3]) if i not in chosen)


def test_selection(spark):
    hits = spark.createDataFrame([("q1", "q1", 100.0, 300, 90.0), ("q1", "b", 95.0, 300, 80.0), ("q1", "a", 95.0, 300, 80.0), ("q2", "b", 50.0, 100, 10.0)], "qseqid string, sseqid string, pident double, length int, bitscore double")
    assert {r["qseqid"]: r["sseqid"] for r in sel.best_hits(hits, drop_self=True).collect()} == {"q1": "a", "q2": "b"}
    assert sel.strong_hits(hits).count() == 3
    ids = spark.createDataFrame([("x|AB_12|CD_3",), ("nothing",)], "id string")
    tags = spark.createDataFrame([("CD_3",), ("AB_12",)], "tag string")
    assert {r["id"]: r["tag"] for r in sel.first_contained(ids, tags, "id", "tag").collect()} == {"x|AB_12|CD_3": "AB_12", "nothing": None}
    meta = spark.createDataFrame([("a", "a", 96.0, 1.0), ("b", "a", 99.0, 0.0), ("c", "c", 90.0, 0.0)], "accession string, gtdb_genome_representative string, checkm2_completeness double, checkm2_contamination double")
    assert [r["accession"] for r in sel.representatives(meta).collect()] == ["a"]
    cds = spark.createDataFrame([("x", None, 50), ("tail", "", 500), ("hypothetical protein", None, 500), ("kinase", None, 500)], "product string, note string, n int")
    assert [r["v"] for r in cds.select(sel.exclusion_reason("product", "note", F.col("n"), 100, 1000, F.lit(False)).alias("v")).collect()] == ["short", "phage keyword", "hypothetical", None]
    a = spark.createDataFrame([(i, chr(97 + i)) for i in range(20)], "i int, x string")
    j = sel.joined_by_place(a, "i", a.select(F.col("i").alias("k"), F.col("x").alias("y")), "k")
    assert j.count() == 20 and j.filter("x <> y").isEmpty()


def test_models(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in rng.normal(2.0 * (i % 2), 1, 3)], float(i % 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, f array<double>, label double")
    out = learn.linear_probe(df.filter("id < 200"), df.filter("id >= 200"), "f", iterations=50)
    assert out.filter("pred = label").count() > 80
    assert learn.perceptron(df.filter("id < 200"), df.filter("id >= 200"), "f", 3, (8,)).filter("pred = label").count() > 80
    v = learn.explained_variance(df, "f", 2)
    assert 1 >= v[0] >= v[1] >= 0
    s = learn.silhouette(df.withColumn("label", F.col("label").cast("int")), "id", "f", "label", every=10).collect()
    x, y = np.array([r[1] for r in rows]), np.array([int(r[2]) for r in rows])
    for r in s[:5]:
        d = np.sqrt(((x - x[r["id"]]) ** 2).sum(axis=1))
        a, b = d[y == y[r["id"]]].sum() / ((y == y[r["id"]]).sum() - 1), d[y != y[r["id"]]].mean()
        assert r["silhouette"] == pytest.approx((b - a) / max(a, b))
    k = spark.createDataFrame([("AACC",), ("NN",)], "s string").select(learn.kmer_vector("s", 2).alias("v")).collect()
    assert sum(k[0]["v"]) == pytest.approx(1) and k[0]["v"][0] == pytest.approx(1 / 3) and sum(k[1]["v"]) == 0


def test_sketch_distances(spark):
    rng = random.Random(7)
    base = "".join(rng.choice("ACGT") for _ in range(2000))
    near = list(base)
    for i in range(0, 2000, 200):
        near[i] = "A" if near[i] != "A" else "C"
    df = spark.createDataFrame([("a", base), ("b", "".join(near)), ("c", "".join(rng.choice("ACGT") for _ in range(2000))), ("d", None)], "id string, s string")
    got = learn.sketch_distances(df, "id", "s").collect()
    assert [(r["a"], r["b"]) for r in got] == [("a", "b")] and 0 < got[0]["distance"] < 0.02
    assert math.isclose(got[0]["distance"], -math.log(2 * got[0]["jaccard"] / (1 + got[0]["jaccard"])) / 21)


def test_pipeline(spark):
    rng = random.Random(8)
    seq = "".join(rng.choice("AT") for _ in range(6000)) + "".join(rng.choice("GC") for _ in range(9000)) + "".join(rng.choice("AT") for _ in range(5000))
    df = spark.createDataFrame([("G1", "c1", seq), ("G1", "c2", seq[:3000])], "assembly string, seq_id string, sequence string")
    cut = pl.segment(df, "assembly", 2000, 1000)
    ids = [r["segment_id"] for r in cut.orderBy("segment_id").collect()]
    assert ids == [f"G1_seg_{i:05d}" for i in range(1, 22)]
    got = pl.genome_wide(df, "assembly", {"gc": pl.gc_scorer()}).collect()
    assert len(got) == 1 and abs(got[0]["start"] - 6000) <= 2000 and abs(got[0]["end"] - 15_000) <= 2000


def test_storage(spark, tmp_path):
    df = materialize(spark.range(5), "five")
    assert df.count() == 5 and "Parquet" in df._jdf.queryExecution().toString()
    assert shared_dir(spark)


def test_rolling_medians_and_smoothing_by_hand():
    rng = np.random.default_rng(3)
    for n, width in ((1, 5), (40, 1), (300, 4), (300, 7), (50, 200)):
        v = np.round(rng.normal(size=n), 1)
        v[rng.random(n) < 0.1] = np.nan
        middle, spread = sg._medians(v, width)
        for i in range(n):
            f = v[max(0, i - width // 2) : i + (width - 1) // 2 + 1]
            f = f[~np.isnan(f)]
            if len(f):
                m = np.median(f)
                assert middle[i] == pytest.approx(m) and spread[i] == pytest.approx(np.median(np.abs(f - m)))
            else:
                assert np.isnan(middle[i])
    v = rng.normal(size=501)
    y = [v[0]]
    for x in v[1:]:
        y.append(y[-1] + 0.4 * (x - y[-1]))
    assert sg._decayed(v, 0.4) == pytest.approx(np.array(y))
    gone = v.copy()
    gone[[0, 100, 500]] = np.nan
    assert np.isnan(sg.ewm_both_ways(gone, 4)[[0, 100, 500]]).all() and np.isnan(sg.ewm_both_ways(gone, 4)).sum() == 3


def test_collapse_majority(spark):
    rows = spark.createDataFrame([("g", f"s{i}", 0, 1000, 0.5, i % 2, 0) for i in range(4)], "g string, segment_id string, start bigint, end bigint, score double, pred int, label int")
    assert [sg.collapse(rows, ["g"], 1000, strict).first()["pred"] for strict in (True, False)] == [0, 1]


def test_one_key_in_many_batches(spark):
    """A key with a third of all rows, over several Arrow batches."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        df = spark.range(900).selectExpr("IF(id % 3 = 0, 'hot', concat('k', id % 50)) AS k", "id AS o", "CAST(id % 7 AS DOUBLE) AS v")
        got = {(r["k"], r["o"]): r["smooth"] for r in sg.smooth(df, ["k"], "o", "v", 5).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 900
    for key in ("hot", "k1", "k2"):
        o = sorted(x for k, x in got if k == key)
        assert [got[key, x] for x in o] == pytest.approx(sg.ewm_both_ways(np.array([float(x % 7) for x in o]), 5))


def test_proportional_allocation_by_units():
    """Against the rule carried out one unit at a time."""
    rng = random.Random(11)
    for _ in range(300):
        counts = {f"g{i}": rng.choice([0, 1, 2, 5, 40, 300]) for i in range(rng.randrange(1, 9))}
        whole, groups = sum(counts.values()), [k for k in sorted(counts, key=lambda k: (-counts[k], k)) if counts[k]]
        total = rng.randrange(len(groups), 60) if len(groups) < 60 else 60
        for repair in ("largest", "smallest"):
            got = sm.proportional_allocation(counts, total, repair)
            goal = min(total, whole)
            want = {k: min(counts[k], max(1, goal * counts[k] // whole)) for k in groups} if goal else {}
            while sum(want.values()) > goal:
                able = [k for k in groups if want[k] > 1]
                want[max(able, key=lambda k: want[k]) if repair == "largest" else min(able, key=lambda k: want[k])] -= 1
            turn = 0
            while sum(want.values()) < goal:
                k = groups[turn % len(groups)] if repair == "largest" else next(k for k in groups if want[k] < counts[k])
                turn += 1
                if want[k] < counts[k]:
                    want[k] += 1
            assert got == want, (counts, total, repair)
    assert sum(sm.proportional_allocation({f"g{i}": i + 1 for i in range(9)}, 4).values()) == 4
