"""Overlaps and near duplicates against all pairs, and their defined cases."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrow.llm import minwise, stretches as st
from windrow.llm.cross_split import cross_split_pairs, cross_split_report
from windrow.llm.near_duplicates import near_duplicate_groups, near_duplicate_pairs

SCHEMA = "segment_id string, sequence string, label int, source string, tid int, bucket string"
_COMPLEMENT = str.maketrans("ACGT", "TGCA")


def brute(seq):
    """The distinct stretches of a sequence, as strings."""
    s = "".join(c for c in (seq or "").upper() if c.isalpha())
    words = (s[i : i + 16] for i in range(len(s) - 15))
    return {min(w, w[::-1].translate(_COMPLEMENT)) for w in words if set(w) <= set("ACGT")}


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def edited(rng, s, edits):
    s = list(s)
    for _ in range(edits):
        i = rng.randrange(len(s))
        s[i] = rng.choice(["", "A", "C", "G", "T", s[i] + "G"])
    return "".join(s)


def family(rng, copies=6):
    out = []
    for _ in range(8):
        base = dna(rng, rng.randrange(400, 900))
        out.append(base)
        for _ in range(copies):
            out.append(edited(rng, base, rng.randrange(1, 14)))
        out.append(base[300:] + base[:300])
        out.append(base[::-1].translate(_COMPLEMENT))
        out.append(base.lower().replace("a", "a \n"))
    return out


def table(spark, rows):
    return spark.createDataFrame([(f"s{i:04d}" if isinstance(r, str) or r is None else r[0], r if isinstance(r, str) or r is None else r[1], i % 2, "gtdb", i, "x") for i, r in enumerate(rows)], SCHEMA)


def all_pairs(rows, test):
    sets = {i: brute(s) for i, s in rows}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and test(sets[a], sets[b])}


def test_stretches_are_those_of_the_definition():
    import pyarrow as pa

    rng = random.Random(1)
    texts = [dna(rng, 60), "ACGT", None, "", dna(rng, 20) + "N" + dna(rng, 40), dna(rng, 30).lower() + " -\t" + dna(rng, 9), "é" + dna(rng, 40), "N" * 50]
    codes, starts = st.encode(pa.array(texts))
    for i, one in enumerate(st.each_record(codes, starts)):
        assert len(st.distinct(one)) == len(brute(texts[i]))
        assert (st.unpack(st.pack(one)) == one).all()
    one_by_one, counts = st.signatures(codes, starts, st.multipliers(4), True)
    for i, one in enumerate(st.each_record(codes, starts)):
        alone, n = st.signatures(one, st.np.array([0, len(one)]), st.multipliers(4), True)
        assert (alone[0] == one_by_one[i]).all() and n[0] == counts[i]


@pytest.mark.parametrize("cap", [minwise.CAP, 2])
def test_near_duplicates_find_all_pairs(spark, monkeypatch, cap):
    """With a small cap all buckets are hot and are parted; no pair may be lost."""
    monkeypatch.setattr(minwise, "CAP", cap)
    monkeypatch.setattr(minwise.candidates, "__defaults__", (cap, "found"))
    rows = family(random.Random(2)) + [None, "", "NNNNNNNNNNNNNNNNNNNN", "ACGTA"]
    df = table(spark, rows)
    got = {(r["segment_id_a"], r["segment_id_b"]) for r in near_duplicate_pairs(df.unionByName(df.limit(5))).collect()}
    want = all_pairs([(f"s{i:04d}", s) for i, s in enumerate(rows)], lambda a, b: 2 * len(a & b) >= len(a | b))
    assert got == want


@pytest.mark.parametrize("cross, least_hits", [(False, 1), (False, 2), (True, 1), (True, 2)])
@pytest.mark.parametrize("block", [minwise.BLOCK, 7])
def test_hot_buckets_lose_no_pair(spark, monkeypatch, block, cross, least_hits):
    """A bucket of 70 texts; most pairs share nothing else, some one or two small buckets or a second hot one."""
    monkeypatch.setattr(minwise, "BLOCK", block)
    np = st.np
    sigs = np.random.default_rng(7).integers(1 << 32, size=(90, 24), dtype=np.uint64).astype(np.uint32)
    sigs[:70, 5] = 1
    sigs[10:72, 17] = 2
    for i in range(0, 88, 2):
        sigs[i + 1, i % 24] = sigs[i, i % 24]
        sigs[i + 1, (i + 7) % 24] = sigs[i, (i + 7) % 24]
    rows = [(i - 45, i % 3 % 2, 100, bytearray(sigs[i].tobytes())) for i in range(90)] + [(-45, 1, 100, bytearray(sigs[0].tobytes()))]
    feats = spark.createDataFrame(rows if cross else [(t, 0, n, s) for t, _, n, s in rows[:90]], "tid bigint, side int, size int, sig binary")
    shared = (sigs[:, None, :] == sigs[None, :, :]).sum(axis=2)
    sides = {(t, side) for t, side, _, _ in rows}
    want = {(a - 45, b - 45) for a in range(90) for b in range(90) if a != b and shared[a, b] >= least_hits and ((a - 45, 0) in sides and (b - 45, 1) in sides if cross else a < b)}
    # a threshold so low that no test by sizes or hot shares applies
    search = minwise.Search(24, 1, 0.01, of_smaller=True, cross=cross, least_hits=least_hits, ratio=4.0)
    got = [tuple(r) for r in minwise.candidates(feats, search).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_groups_are_the_components_of_the_pairs(spark):
    rows = family(random.Random(3), 3) + [None, "ACGT"]
    df = table(spark, rows)
    groups = {r["segment_id"]: r for r in near_duplicate_groups(df).collect()}
    assert len(groups) == len(rows)
    for a, b in all_pairs([(f"s{i:04d}", s) for i, s in enumerate(rows)], lambda a, b: 2 * len(a & b) >= len(a | b)):
        assert groups[a]["group_id"] == groups[b]["group_id"]
    assert groups[f"s{len(rows) - 1:04d}"]["group_size"] == 1
    sizes = {}
    for r in groups.values():
        sizes[r["group_id"]] = sizes.get(r["group_id"], 0) + 1
    assert all(r["group_size"] == sizes[r["group_id"]] for r in groups.values())


@pytest.mark.parametrize("cap", [minwise.CAP, 2])
def test_cross_split_pairs(spark, monkeypatch, cap):
    monkeypatch.setattr(minwise.candidates, "__defaults__", (cap, "found"))
    rng = random.Random(4)
    base = [dna(rng, 700) for _ in range(6)]
    train = [(f"t{i}", s) for i, s in enumerate(base)] + [("t_copy", base[0])]
    val = [("v0", base[0]), ("v1", base[1][100:450]), ("v2", dna(rng, 300) + base[2] + dna(rng, 900)), ("v3", dna(rng, 500)), ("v4", edited(rng, base[3], 6)), ("v5", None)]
    pairs = cross_split_pairs(table(spark, train), {"val": table(spark, val), "test": table(spark, [("e0", base[4].lower())])})
    got = {(r["train_id"], r["eval_id"]) for r in pairs.collect()}
    want = set()
    for a, s in train:
        for b, t in [*val, ("e0", base[4])]:
            x, y = brute(s), brute(t)
            if x and y and len(x & y) >= 0.6 * min(len(x), len(y)):
                want.add((a, b))
    assert got == want and ("t1", "v1") in got and ("t2", "v2") in got
    report = {r["split"]: r for r in cross_split_report(pairs).collect()}
    assert report["test"]["pairs"] == 1 and report["val"]["pairs"] == len(want) - 1


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicate_pairs(empty).isEmpty() and near_duplicate_groups(empty).isEmpty()
    assert cross_split_pairs(empty, {"val": empty}).isEmpty()


def test_one_text_held_by_many(spark):
    """A third of all rows are copies of one text, others near copies of it."""
    rng = random.Random(5)
    base = dna(rng, 500)
    rows = [base] * 60 + [edited(rng, base, 3) for _ in range(40)] + [dna(rng, 500) for _ in range(80)]
    groups = near_duplicate_groups(table(spark, rows)).collect()
    assert max(r["group_size"] for r in groups) == 100
    assert max(r["links"] for r in groups) <= 40  # copies aren't expanded


def test_long_sequence_and_schema(spark):
    rng = random.Random(6)
    long = dna(rng, 300_000)
    df = table(spark, [("a", long), ("b", long[:200_000] + "N" * 40 + long[200_000:]), (None, long)])
    assert [(r["segment_id_a"], r["segment_id_b"]) for r in near_duplicate_pairs(df).collect()] == [("a", "b")]
    assert isinstance(near_duplicate_pairs(df).schema["similarity"].dataType, T.DoubleType)


def _shared_stretch(rng, n, groups=1):
    """Records of 1,000 bases of which 300 are those of all others; every tenth is followed by a near copy of itself."""
    common = [dna(rng, 300) for _ in range(groups)]
    out = []
    for i in range(n):
        at = rng.randrange(701)
        own = dna(rng, 700)
        out.append(own[:at] + common[i % groups] + own[at:])
        if i % 10 == 0:
            out.append(edited(rng, out[-1], 12))
    return out


@pytest.mark.parametrize("n", [300, 1200])
def test_texts_that_share_a_stretch_are_no_candidates(spark, n):
    """Hot buckets of records with a common stretch give candidates in proportion to the records, and the near copies among them are found."""
    rows = _shared_stretch(random.Random(8), n)
    df = spark.createDataFrame([(f"s{i:05d}", 0, None, None, x) for i, x in enumerate(rows)], "id string, side int, label int, source string, sequence string")
    feats = minwise.features(df, st.multipliers(32), True, "t")
    search = minwise.Search(64, 2, 0.5, of_smaller=False, cross=False)
    assert minwise.candidates(feats, search).count() < 10 * len(rows)
    near = near_duplicate_pairs(table(spark, [(f"s{i:05d}", x) for i, x in enumerate(rows)])).count()
    assert near == sum(i % 10 == 0 for i in range(n))
    # the same across splits: near copies lie next to each other, so sides alternate
    feats = minwise.features(df.withColumn("side", (F.substring("id", 2, 5).cast("int") % 2).cast("int")), st.multipliers(72), False, "t")
    search = minwise.Search(72, 1, 0.6, of_smaller=True, cross=True, least_hits=2, ratio=4.0)
    pairs = minwise.candidates(feats, search)
    assert pairs.count() < 10 * len(rows)


def test_large_families_are_found_whole(spark):
    """Families of more texts than a small bucket holds, whose stretches are nearly all common."""
    rng = random.Random(9)
    base = dna(rng, 800)
    rows = [edited(rng, base, 9) for _ in range(80)] + [dna(rng, 800) for _ in range(40)]
    want = all_pairs([(f"s{i:04d}", x) for i, x in enumerate(rows)], lambda a, b: 2 * len(a & b) >= len(a | b))
    got = {(r["segment_id_a"], r["segment_id_b"]) for r in near_duplicate_pairs(table(spark, rows)).collect()}
    assert len(want) > 1500 and got <= want and len(want - got) <= 0.002 * len(want)
    train, val = [(f"t{i}", x) for i, x in enumerate(rows[::2])], [(f"v{i}", x) for i, x in enumerate(rows[1::2])]
    sets = {k: brute(x) for k, x in train + val}
    want = {(a, b) for a, _ in train for b, _ in val if len(sets[a] & sets[b]) >= 0.6 * min(len(sets[a]), len(sets[b]))}
    got = {(r["train_id"], r["eval_id"]) for r in cross_split_pairs(table(spark, train), {"val": table(spark, val)}).collect()}
    assert len(want) > 500 and got <= want and len(want - got) <= 0.002 * len(want)


@pytest.mark.parametrize("small, large, share", [(400, 2400, 0.62), (300, 3600, 0.62), (240, 3600, 0.62), (150, 3600, 0.7), (60, 3000, 1.0), (1000, 2000, 0.62), (900, 3400, 0.62)])
def test_overlaps_of_records_of_unlike_size(spark, small, large, share):
    rng = random.Random(small + large)
    train, val, n = [], [], 60
    for i in range(n):
        whole, part = dna(rng, large), int((small - 15) * share) + 16
        at = rng.randrange(large - part)
        one = whole[at : at + part] + dna(rng, small - part)
        (train if i % 2 else val).append((f"w{i}", whole))
        (val if i % 2 else train).append((f"p{i}", one))
    got = {(r["train_id"], r["eval_id"]) for r in cross_split_pairs(table(spark, train), {"val": table(spark, val)}).collect()}
    want = {(f"w{i}", f"p{i}") if i % 2 else (f"p{i}", f"w{i}") for i in range(n)}
    assert got == want
