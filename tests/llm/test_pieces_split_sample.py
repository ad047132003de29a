"""Pieces, group splits and quota samples against plain versions, and their defined cases."""

import random

import numpy as np
import pytest

from windrow.llm import group_split as gs
from windrow.llm import pieces as pc
from windrow.llm import sampling as qs
from windrow.llm.related import assembly_groups, related_pairs, segment_groups


def greedy(marks, limit, overlap):
    """The same cuts, one after the other."""
    s, end, out = 0, marks[-1], []
    while end - s > limit:
        near = [m for m in marks if s < m <= s + limit]
        if near:
            out.append((s, max(near), False))
            s = max(near)
        else:
            out.append((s, s + limit, True))
            s += limit - overlap
    return [*out, (s, int(end), False)]


def test_pointer_doubling_is_greedy():
    rng = random.Random(1)
    for _ in range(300):
        limit = rng.randrange(3, 40)
        overlap = rng.randrange(0, limit)
        marks = []
        for _ in range(rng.randrange(1, 6)):
            n = rng.randrange(1, 400)
            marks.append(np.unique(np.array([0, n, *(rng.randrange(0, n + 1) for _ in range(rng.randrange(0, 12)))])))
        record, begin, end, forced = pc.greedy_cuts(marks, limit, overlap)
        for i, m in enumerate(marks):
            mine = [(int(b), int(e), bool(f)) for r, b, e, f in zip(record, begin, end, forced, strict=True) if r == i]
            assert mine == greedy(m.tolist(), limit, overlap)


def test_boundaries_of_gaps():
    b = lambda s: pc.boundaries(np.frombuffer(s.encode(), np.uint8), 20, 10).tolist()
    assert b("ACGT") == [0, 4]
    assert b("AC" + "N" * 9 + "GT") == [0, 13]
    assert b("AC" + "N" * 10 + "GT") == [0, 2, 12, 14]
    assert b("N" * 50) == [0, 20, 40, 50]


def test_pieces_of_a_table(spark):
    rng = random.Random(2)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    gap = dna(6000) + "N" * 30 + dna(5000)
    rows = [
        ("plain", 1000, 99, dna(17_000), None, 1), ("gap", None, 50_000, gap, None, 1), ("gap", None, 50_000, gap, None, 1), ("edge", 0, 0, dna(8000), None, 1), ("short", 5, 10, "ACGT", None, 1),
        ("dirty", None, None, " - ".join([dna(4500), dna(4500).lower()]), None, 1), (None, 0, 0, dna(9000), None, 1), ("null", 0, 0, None, None, 1), ("space", 0, 0, "A " * 7000, None, 1),
    ]
    df = spark.createDataFrame(rows, "segment_id string, start bigint, end bigint, sequence string, loaded_at timestamp, piece int")
    got = {}
    for r in pc.split_oversized(df).orderBy("segment_id", "piece").collect():
        got.setdefault(r["segment_id"], []).append(r)
    assert set(got) == {"plain", "gap", "dirty"}
    assert [(r["from_base"], r["to_base"], r["cut"]) for r in got["plain"]] == [(0, 8000, "forced"), (7800, 15_800, "forced"), (15_600, 17_000, "end")]
    assert [(r["start"], r["end"]) for r in got["plain"]] == [(1000, 9000), (8800, 16_800), (16_600, 18_000)]
    assert [(r["from_base"], r["to_base"], r["cut"]) for r in got["gap"]] == [(0, 6030, "gap"), (6030, 11_030, "end")]
    assert got["gap"][0]["start"] == 50_000 - 11_030 and "".join(r["sequence"] for r in got["gap"]) == gap
    assert got["dirty"][0]["start"] is None and len(got["dirty"]) == 2
    assert pc.split_oversized(df.limit(0)).isEmpty()


def test_largest_differencing_keeps_weights_and_balances():
    rng = np.random.default_rng(3)
    tuples = []
    for w in rng.integers(1, 50, 200):
        t = np.zeros((5, 2))
        t[0] = [w, w // 3]
        tuples.append(t)
    bins, where = gs.largest_differencing(tuples)
    again = np.zeros_like(bins)
    for t, to in zip(tuples, where, strict=True):
        again[to] += t
    assert np.allclose(again, bins)
    total = bins.sum(axis=1)
    assert total.max() - total.min() <= 2


def test_bins_are_allocated_by_share_and_label():
    weights = np.array([[10.0, 1.0]] * 50 + [[10.0, 2.0]] * 50)
    to = gs.allocate_bins(weights, [0.8, 0.1, 0.1])
    got = np.array([weights[to == s].sum(axis=0) for s in range(3)]) / weights.sum(axis=0)
    assert np.allclose(got, [[0.8, 0.8], [0.1, 0.1], [0.1, 0.1]], atol=0.011)


@pytest.mark.parametrize("leaf", [gs.LEAF, 16])
def test_group_split(spark, monkeypatch, leaf):
    """Also through several levels of the tree."""
    monkeypatch.setattr(gs, "LEAF", leaf)
    monkeypatch.setattr(gs, "FAN", 3)
    rng = random.Random(4)
    rows = [(f"s{i}", int(rng.random() < 0.3), f"g{min(rng.randrange(300), rng.randrange(300))}") for i in range(6000)] + [(f"h{i}", 0, "hot") for i in range(3000)]
    out = gs.group_split(spark.createDataFrame(rows, "segment_id string, label int, group_id string"))
    got = out.collect()
    assert sorted(r["segment_id"] for r in got) == sorted(r[0] for r in rows)
    of = {}
    for r in got:
        assert of.setdefault(r["group_id"], r["split"]) == r["split"]
    share = {(r["split"], r["label"]): r["share"] for r in gs.split_report(out).collect()}
    for (split, _), s in share.items():
        assert abs(s - gs.SHARES[split]) < 0.02
    assert of["hot"] == "train"
    assert gs.group_split(spark.createDataFrame([], "segment_id string, label int, group_id string")).isEmpty()


def test_related_assemblies(spark):
    known = spark.createDataFrame([
        ("GCF_700000001.1", "NZ_1.1"), ("GCA_700000001.1.fna", None), ("other", " nz_1.1 "), ("other", "NZ_2.1"), ("GCF_700000003.1", "NZ_2.1"), ("alone", "NZ_9.1"), (None, "NZ_9.1"), ("", "NZ_9.1"), ("GCF_700000005.1", ""), ("alone", "NZ_9.1"),
    ], "assembly string, ncbi_id string")
    groups = {r["assembly"]: r["group_id"] for r in assembly_groups(known).collect()}
    assert len(groups) == 6 and len({groups[a] for a in ("GCF_700000001.1", "GCA_700000001.1.fna", "other", "GCF_700000003.1")}) == 1 and len(set(groups.values())) == 3
    assert related_pairs(assembly_groups(known)).count() == 6
    segments = spark.createDataFrame([("GCF_700000001.1_seg_1", "nz_2.1", 1), ("GCF_799999999.1_seg_1", "NZ_7.1", 0), ("GCF_799999999.1_seg_2", None, 0), ("x", None, 1), ("y", "NZ_8.1", None), ("x", None, 1)], "segment_id string, seq_id string, label int")
    maps = spark.createDataFrame([("NZ_7.1", "GCF_799999999.1"), (None, "GCF_1"), ("NZ_8.1", None)], "contig_id string, genome_accession string")
    got = {r["segment_id"]: r["group_id"] for r in segment_groups(segments, known, maps).collect()}
    assert set(got) == {"GCF_700000001.1_seg_1", "GCF_799999999.1_seg_1", "GCF_799999999.1_seg_2", "x"}
    assert got["GCF_799999999.1_seg_1"] == got["GCF_799999999.1_seg_2"]


def test_controlled_rounding_keeps_margins():
    import math

    rng = random.Random(5)
    for _ in range(200):
        cells = {(r, c): rng.random() * 5 for r in range(rng.randrange(1, 5)) for c in "abcd" if rng.random() < 0.8}
        if not cells:
            continue
        got = qs.controlled_rounding(cells)

        def near(whole, value):
            return math.floor(value + 1e-9) <= whole <= math.ceil(value - 1e-9)

        assert all(near(got[k], v) for k, v in cells.items())
        for axis in (0, 1):
            for name in {k[axis] for k in cells}:
                assert near(sum(got[k] for k in cells if k[axis] == name), sum(v for k, v in cells.items() if k[axis] == name))
        assert near(sum(got.values()), sum(cells.values()))


def test_wants_keep_the_size():
    assert qs.scaled_wants([0.5, 0.5], [0, 0], 10) == [5, 5]
    w = qs.scaled_wants([0.6, 0.38, 0.02], [0, 0, 20], 100)
    assert w[2] == 20 and abs(sum(w) - 100) < 1e-6 and abs(w[0] / w[1] - 0.6 / 0.38) < 1e-6
    assert qs.scaled_wants([0.5, 0.5], [80, 40], 100) == [80, 40]


def test_quota_sample(spark):
    rows = [(f"a{i}", 0, "GTDB ") for i in range(600)] + [(f"b{i}", 1, "inphared") for i in range(300)] + [(f"c{i}", 1, "rare") for i in range(2)] + [(f"d{i}", None, "gtdb") for i in range(50)] + [(f"e{i}", 1, None) for i in range(50)] + [("a1", 0, "gtdb")] * 3 + [(f"f{i}", 1, "other") for i in range(98)]
    df = spark.createDataFrame(rows, "segment_id string, label int, source string")
    targets = spark.createDataFrame([(0, "gtdb", 0.5, 3), (1, "inphared", 0.45, 3), (1, "rare", 0.05, 5)], "label int, source string, target_share double, min_rows bigint")
    sample, report = qs.quota_sample(df, targets)
    got = {r["source"]: r for r in report.collect()}
    assert got["gtdb"]["pool_rows"] == 600 and got["gtdb"]["sampled"] == got["gtdb"]["quota"] == 125
    assert got["inphared"]["sampled"] in (112, 113) and got["rare"]["sampled"] == 2
    assert [s for s, r in got.items() if r["short"]] == ["rare"]
    assert sample.count() == sample.select("segment_id").distinct().count()
    again, _ = qs.quota_sample(df, targets)
    assert {r[0] for r in sample.select("segment_id").collect()} == {r[0] for r in again.select("segment_id").collect()}
    empty, short = qs.quota_sample(df.limit(0), targets)
    assert empty.isEmpty() and short.filter("short").count() == 3
