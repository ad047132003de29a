"""Candidate search by banded minwise signatures and exact checks of the candidates.

The plan: one Arrow pass over the sequences gives each record a text number (a hash of its
bases), a signature, its number of distinct stretches and its bases packed in bits; these go to the shared folder. Each band
of the signature becomes a row (bucket, text). Rows are hash-partitioned and sorted by bucket, and a
streaming pass over the sorted rows writes the pairs of each bucket. The pass holds at most
``cap`` rows of a bucket. A bucket with more rows is hot.

Hot buckets come from stretches that very many texts have. The share of a text's bands that are hot tells
how many of its stretches are of that kind, and with it how many stretches of any pair sought must be of the other kind.
If that makes a band that is not hot likely enough to be shared, the pair is left to the small buckets
(it is missed there with probability ``LOST`` at most), and texts that need no other way leave the hot buckets. So
texts that merely share a common piece cost nothing more. Those that consist of common stretches in the main meet by hot
bucket and size class, in blocks of about ``BLOCK`` texts, every two blocks in a task of their own, and are compared by
their whole signatures; of any group of them nearly all pairs are pairs sought. Copies of one text are one row throughout.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm import stretches as st
from windrow.ship import map_arrow
from windrow.storage import materialize

#: Largest bucket whose pairs are written directly.
CAP = 48
#: Texts of a hot bucket in one block, about.
BLOCK = 1024
#: Most probable loss of a pair at the threshold that is left to the small buckets, and that of the test by signatures.
LOST, UNLIKE = 1e-3, 1e-4
#: Ratio of neighbouring size classes in hot buckets.
CLASS = 1.25
#: Bits of a bucket's number that hold its band.
_BAND_BITS = 7

FEATURES = "id string, side int, label int, source string, tid bigint, size int, sig binary, packed binary"
FEATURES_ARROW = pa.schema([("id", pa.string()), ("side", pa.int32()), ("label", pa.int32()), ("source", pa.string()), ("tid", pa.int64()), ("size", pa.int32()), ("sig", pa.binary()), ("packed", pa.binary())])
ROWS = "bucket bigint, tid bigint, side int"
ROWS_ARROW = pa.schema([("bucket", pa.int64()), ("tid", pa.int64()), ("side", pa.int32())])
FOUND = "a bigint, b bigint, bucket bigint, side int"
FOUND_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bucket", pa.int64()), ("side", pa.int32())])


def least_matches(values: int, chance: float, loss: float = UNLIKE) -> int:
    """The greatest m such that fewer than m of the values match with probability at most loss, each having this chance."""
    if chance >= 1:
        return values
    p, total, m = (1 - chance) ** values, 0.0, 0
    while m < values and total + p <= loss:
        total += p
        p *= chance / (1 - chance) * (values - m) / (m + 1)
        m += 1
    return m


@dataclass(frozen=True)
class Search:
    """What is sought: pairs of texts with sizes m <= n and at least share * m stretches in common, or else share of all stretches of both.

    With cross, one text is of side 0 and the other of side 1. ratio is the greatest n / m that the search must find.
    """

    width: int
    per_band: int
    share: float
    of_smaller: bool
    cross: bool
    least_hits: int = 1
    ratio: float = math.inf

    @property
    def bands(self) -> int:
        return self.width // self.per_band

    def common(self, small, large):
        """Stretches that a pair sought has in common at least."""
        return self.share * small if self.of_smaller else self.share / (1 + self.share) * (small + large)

    def similarity(self, small, large):
        """Jaccard similarity of a pair sought at least."""
        c = self.common(small, large)
        return c / (small + large - c)

    def enough(self) -> float:
        """The chance of a band from which on all but LOST of the pairs have least_hits bands in common."""
        low, high = 0.0, 1.0
        for _ in range(50):
            p = (low + high) / 2
            missed = sum(math.comb(self.bands, k) * p**k * (1 - p) ** (self.bands - k) for k in range(self.least_hits))
            low, high = (p, high) if missed > LOST else (low, p)
        return high

    def frequent(self, small, large):
        """So many stretches of hot buckets may the text with fewer of them have, for the pair to be left to the small buckets; below 0: never."""
        c = self.common(small, large)
        union = small + large - c
        spare = (c / union) ** self.per_band - self.enough()
        return np.where(spare >= 0, union * np.maximum(spare, 0) ** (1 / self.per_band), -1.0)

    def classes(self) -> list[tuple[int, float, float]]:
        """Of every distance of two size classes that a pair may have: the distance, and the shares of hot stretches from which on the smaller and the larger text are paired in hot buckets."""
        out = []
        widest = self.ratio if self.of_smaller else min(self.ratio, 1 / self.share)
        d = 0
        while d == 0 or CLASS ** (d - 1) < widest and d < 64:
            # sizes 1..CLASS of the smaller class and CLASS**d times these of the larger one
            corners = [(a, b * CLASS**d) for a in (1.0, CLASS) for b in (1.0, CLASS)]
            least = min(float(self.frequent(min(x), max(x))) for x in corners)
            out.append((d, least / CLASS, least / CLASS ** (d + 1)))
            d += 1
        return out


def features(records: DataFrame, orders: np.ndarray, both_ends: bool, name: str) -> DataFrame:
    """records(id, side, label, source, sequence) with text number, signature and packed bases, written once.

    Records without any stretch have null for these. size counts distinct stretches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, starts = st.encode(batch.column("sequence"))
            sigs, counts = st.signatures(codes, starts, orders, both_ends)
            tid, size, sig, packed = [], [], [], []
            for i, one in enumerate(st.each_record(codes, starts)):
                has = counts[i] > 0
                tid.append(xxhash.xxh3_64_intdigest(one.tobytes()) - (1 << 63) if has else None)
                size.append(int(counts[i]) if has else None)
                sig.append(sigs[i].tobytes() if has else None)
                packed.append(st.pack(one) if has else None)
            keep = [batch.column(c) for c in ("id", "side", "label", "source")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(tid, pa.int64()), pa.array(size, pa.int32()), pa.array(sig, pa.binary()), pa.array(packed, pa.binary())], schema=FEATURES_ARROW)

    return materialize(map_arrow(records.select("id", "side", "label", "source", "sequence"), run, FEATURES), name)


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _signature_matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, width)


def _band_numbers(sigs: np.ndarray, per_band: int) -> np.ndarray:
    """One 64-bit number per record and band; the last _BAND_BITS bits are the band."""
    n, width = sigs.shape
    grouped = sigs.reshape(n, width // per_band, per_band).astype(np.uint64)
    numbers = np.arange(width // per_band, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    for k in range(per_band):
        numbers = _mix(numbers ^ grouped[:, :, k])
    return (numbers << np.uint64(_BAND_BITS)) | np.arange(width // per_band, dtype=np.uint64)[None, :]


def band_rows(feats: DataFrame, width: int, per_band: int) -> DataFrame:
    """(bucket, tid, side): one row per text, side and band; copies within a task are set out once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            if len(seen) > 1_000_000:  # only saves work; copies are one row after the shuffle in any case
                seen.clear()
            fresh = []
            for i, key in enumerate(zip(batch.column("tid").to_pylist(), batch.column("side").to_pylist(), strict=True)):
                if key not in seen:
                    seen.add(key)
                    fresh.append(i)
            if not fresh:
                continue
            batch = batch.take(pa.array(fresh))
            numbers = _band_numbers(_signature_matrix(batch.column("sig"), width), per_band)
            bands = numbers.shape[1]
            tid, side = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), bands) for c in ("tid", "side"))
            yield pa.RecordBatch.from_arrays([pa.array(numbers.ravel().view(np.int64)), pa.array(tid), pa.array(side.astype(np.int32))], schema=ROWS_ARROW)

    return map_arrow(feats.filter("tid IS NOT NULL").select("tid", "side", "sig"), run, ROWS)


def _pairs_of_runs(bucket: np.ndarray, tid: np.ndarray, side: np.ndarray, cross: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of different texts within each run of equal buckets; with cross, of different sides."""
    left, right, at = [], [], []
    d = 1
    while d < len(bucket):
        i = np.flatnonzero(bucket[d:] == bucket[:-d])
        if not len(i):
            break
        j = i + d
        use = tid[i] != tid[j]
        if cross:
            use &= side[i] != side[j]
        i, j = i[use], j[use]
        if cross:
            i, j = np.where(side[i] == 0, i, j), np.where(side[i] == 0, j, i)
        left.append(tid[i])
        right.append(tid[j])
        at.append(bucket[i])
        d += 1
    empty = [np.empty(0, np.int64)]
    return tuple(np.concatenate(x or empty) for x in (left, right, at))


def bucket_pass(cross: bool, cap: int) -> Callable:
    """The streaming pass over rows sorted by bucket and text. Rows out with b null are members of hot buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)]
        hot_now = None

        def members(bucket, tid, side):
            return pa.RecordBatch.from_arrays([pa.array(tid), pa.nulls(len(tid), pa.int64()), pa.array(bucket), pa.array(side)], schema=FOUND_ARROW)

        def settle(bucket, tid, side):
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            sizes = np.repeat(np.diff(edge), np.diff(edge))
            small = (sizes > 1) & (sizes <= cap)
            if small.any():
                a, b, at = _pairs_of_runs(bucket[small], tid[small], side[small], cross)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(at), pa.nulls(len(a), pa.int32())], schema=FOUND_ARROW)
            if (sizes > cap).any():
                big = sizes > cap
                yield members(bucket[big], tid[big], side[big])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)]
            if hot_now is not None:  # the bucket that was passed on already
                cut = int(np.searchsorted(now[0] != hot_now, True)) if (now[0] != hot_now).any() else len(now[0])
                if cut:
                    yield members(*(x[:cut] for x in now))
                now = [x[cut:] for x in now]
                if not len(now[0]):
                    continue
                hot_now = None
            bucket, tid, side = (np.concatenate([h, x]) for h, x in zip(held, now, strict=True))
            fresh = np.ones(len(bucket), bool)  # copies from several tasks
            fresh[1:] = (bucket[1:] != bucket[:-1]) | (tid[1:] != tid[:-1]) | (side[1:] != side[:-1])
            bucket, tid, side = bucket[fresh], tid[fresh], side[fresh]
            last = int(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))[-1])
            if last:
                yield from settle(bucket[:last], tid[:last], side[:last])
            held = [bucket[last:], tid[last:], side[last:]]
            if len(held[0]) > cap:
                yield members(*held)
                hot_now = held[0][0]
                held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)]
        if len(held[0]) > 1:
            yield from settle(*held)

    return run


def _passed(rows: DataFrame, cross: bool, cap: int, name: str) -> DataFrame:
    ordered = rows.repartition("bucket").sortWithinPartitions("bucket", "tid", "side")
    return materialize(map_arrow(ordered, bucket_pass(cross, cap), FOUND), name)


MET = "a bigint, b bigint, hits int"
MET_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("hits", pa.int32())])


def hot_texts(hot: DataFrame, feats: DataFrame, search: Search) -> DataFrame:
    """(tid, size, sig, low, high, frequent): the texts of hot buckets; which of their bands are hot, in two numbers of bits; and about how many stretches of that kind they have."""
    band = F.col("bucket").bitwiseAND(F.lit((1 << _BAND_BITS) - 1))
    bits = [F.when((band >= at) & (band < at + 60), F.call_function("shiftleft", F.lit(1).cast("bigint"), (band - at).cast("int"))).otherwise(F.lit(0).cast("bigint")) for at in (0, 60)]
    marks = hot.groupBy(F.col("a").alias("tid")).agg(F.bit_or(bits[0]).alias("low"), F.bit_or(bits[1]).alias("high"))
    share = (F.bit_count("low") + F.bit_count("high")) / F.lit(float(search.bands))
    texts = feats.filter("tid IS NOT NULL").select("tid", "size", "sig").join(marks, "tid").dropDuplicates(["tid"])
    return texts.withColumn("frequent", F.pow(share, F.lit(1.0 / search.per_band)) * F.col("size"))


def _met(search: Search, band: int, left: dict, right: dict, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of two blocks of a hot bucket that need it, if this is the first hot band they share, and the bands they share."""
    small, large = (f(left["size"][:, None], right["size"][None, :]).astype(np.float64) for f in (np.minimum, np.maximum))
    use = (left["tid"][:, None] != right["tid"][None, :]) & (large <= search.ratio * small)
    if same:
        use &= left["tid"][:, None] < right["tid"][None, :]
    use &= np.minimum(left["frequent"][:, None], right["frequent"][None, :]) > search.frequent(small, large)
    i, j = np.nonzero(use)
    hits, matches, earlier = (np.zeros(len(i), np.int16) for _ in range(3))
    x, y = left["bands"], right["bands"]
    for k in range(search.bands):
        both = x[i, k] == y[j, k]
        hits += both
        if k < band:
            earlier += both & (left["low" if k < 60 else "high"][i] >> np.int64(k % 60) & 1).astype(bool)
    for k in range(search.width):
        matches += left["sig"][i, k] == right["sig"][j, k]
    table = np.array([least_matches(search.width, p / 200) for p in range(201)])
    least = table[np.floor(search.similarity(small[i, j], large[i, j]) * 200).astype(int)]
    good = (earlier == 0) & (hits >= search.least_hits) & (matches >= least)
    return left["tid"][i[good]], right["tid"][j[good]], hits[good].astype(np.int32)


def _hot_pairs(hot: DataFrame, feats: DataFrame, search: Search) -> DataFrame:
    """(a, b, hits): the pairs within hot buckets that the small buckets can't be trusted to give."""
    texts = materialize(hot_texts(hot, feats, search), "hot")
    rank = F.floor(F.log("size") / F.lit(math.log(CLASS))).cast("int")
    light = texts.select("tid", rank.alias("rank"), (F.col("frequent") / F.col("size")).alias("share"))
    members = hot.select("bucket", F.col("a").alias("tid"), "side").join(light, "tid")
    first = F.col("side") == 0 if search.cross else F.lit(True)
    # (i, j): the size classes of the two texts; with cross the first is that of side 0, else i <= j
    ways = []
    for d, small, large in search.classes():
        i, j = F.col("rank"), F.col("rank")
        as_small, as_large = F.col("share") > small, F.col("share") > large
        if d == 0:
            ways.append(F.when(as_small | as_large, F.struct(i.alias("i"), j.alias("j"), first.alias("is_left"))))
        elif search.cross:
            ways.append(F.when(as_small, F.struct(F.when(first, i).otherwise(i + d).alias("i"), F.when(first, i + d).otherwise(i).alias("j"), first.alias("is_left"))))
            ways.append(F.when(as_large, F.struct(F.when(first, i).otherwise(i - d).alias("i"), F.when(first, i - d).otherwise(i).alias("j"), first.alias("is_left"))))
        else:
            ways.append(F.when(as_small, F.struct(i.alias("i"), (i + d).alias("j"), F.lit(True).alias("is_left"))))
            ways.append(F.when(as_large, F.struct((i - d).alias("i"), i.alias("j"), F.lit(False).alias("is_left"))))
    members = members.select("bucket", "tid", F.explode(F.array_compact(F.array(*ways))).alias("w")).select("bucket", "tid", "w.i", "w.j", "w.is_left")
    group = ["bucket", "i", "j"]
    alike = ~F.lit(search.cross) & (F.col("i") == F.col("j"))
    sizes = members.groupBy(*group).agg(F.count_if("is_left").alias("n"), F.count_if(~F.col("is_left")).alias("m"))
    sizes = sizes.filter(F.when(alike, F.col("n") > 1).otherwise((F.col("n") > 0) & (F.col("m") > 0)))
    sizes = sizes.select(*group, F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("p"), F.when(alike, F.ceil(F.col("n") / F.lit(BLOCK))).otherwise(F.ceil(F.col("m") / F.lit(BLOCK))).cast("int").alias("q"))
    dealt = members.join(sizes, group)
    own = F.pmod(F.xxhash64("tid"), F.when(F.col("is_left"), F.col("p")).otherwise(F.col("q"))).cast("int")
    dealt = dealt.withColumn("at", own)
    # the block pairs (r, s) that a text takes part in
    others = F.sequence(F.lit(0), F.when(F.col("is_left"), F.col("q")).otherwise(F.col("p")) - 1)
    within = F.transform(others, lambda k: F.struct(F.least("at", k).alias("r"), F.greatest("at", k).alias("s"), (F.col("at") <= k).alias("l")))
    between = F.transform(others, lambda k: F.struct(F.when(F.col("is_left"), F.col("at")).otherwise(k).alias("r"), F.when(F.col("is_left"), k).otherwise(F.col("at")).alias("s"), F.col("is_left").alias("l")))
    dealt = dealt.withColumn("x", F.explode(F.when(alike, within).otherwise(between)))
    keys = [*group, "r", "s"]
    ordered = dealt.select(*group, "tid", "x.r", "x.s", "x.l").join(texts, "tid").repartition(*keys).sortWithinPartitions(*keys)

    def block(rows: pa.Table, which: np.ndarray) -> dict:
        out = {c: rows.column(c).to_numpy()[which] for c in ("tid", "size", "frequent", "low", "high")}
        out["sig"] = _signature_matrix(rows.column("sig").take(pa.array(which)), search.width)
        out["bands"] = _band_numbers(out["sig"], search.per_band)
        return out

    def settle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, i, j, r, s = (rows.column(c)[0].as_py() for c in keys)
        left = rows.column("l").to_numpy()
        same = not search.cross and i == j and r == s
        first, second = np.flatnonzero(left), np.flatnonzero(left if same else ~left)
        for k in range(0, len(first), BLOCK):  # blocks differ in size
            for n in range(0, len(second), BLOCK):
                if same and n < k:
                    continue
                a, b, hits = _met(search, bucket & ((1 << _BAND_BITS) - 1), block(rows, first[k : k + BLOCK]), block(rows, second[n : n + BLOCK]), same and n == k)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(hits)], schema=MET_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the last key
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(c).to_numpy() for c in keys])
            edge = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist()]
            if held and any(held[0].column(c)[0].as_py() != batch.column(c)[0].as_py() for c in keys):
                yield from settle(pa.Table.from_batches(held))
                held = []
            for start, end in zip(edge, edge[1:]):
                yield from settle(pa.Table.from_batches([*held, batch.slice(start, end - start)]))
                held = []
            held.append(batch.slice(edge[-1]))
        if held:
            yield from settle(pa.Table.from_batches(held))

    return map_arrow(ordered.select(*keys, "tid", "size", "frequent", "low", "high", F.col("l"), "sig"), run, MET)


def candidates(feats: DataFrame, search: Search, cap: int = CAP, name: str = "found") -> DataFrame:
    """(a, b): pairs of different texts that may be pairs sought, each once. With cross, a is a text of side 0 and b one of side 1; else a < b.

    A pair from small buckets shares least_hits of them, and if all its bands were looked at, as many as the sizes of a pair sought make likely.
    """
    found = _passed(band_rows(feats, search.width, search.per_band), search.cross, cap, name)
    pairs = found.filter("b IS NOT NULL").select("a", "b")
    hot = found.filter("b IS NULL")
    if not search.cross:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("hits")).filter(F.col("hits") >= search.least_hits)
    if search.per_band == 1:  # one value a band: the hits are an estimate of the similarity
        sizes = feats.filter("tid IS NOT NULL").select("tid", "size").distinct()
        heats = hot.groupBy(F.col("a").alias("tid")).agg(F.count("*").alias("heat"))
        sizes = sizes.join(heats, "tid", "left").fillna(0, ["heat"])
        for x in "ab":
            pairs = pairs.join(sizes.select(F.col("tid").alias(x), F.col("size").alias(f"size_{x}"), F.col("heat").alias(f"heat_{x}")), x)
        small, large = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
        chance = search.similarity(small, large)
        table = F.array(*(F.lit(least_matches(search.width, p / 100)) for p in range(101)))
        least = F.get(table, F.floor(chance * 100).cast("int"))
        pairs = pairs.filter(F.col("hits") + F.least("heat_a", "heat_b") >= least)
    pairs = pairs.select("a", "b")
    if not hot.isEmpty():
        met = _hot_pairs(hot, feats, search).select("a", "b")
        if not search.cross:
            met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = pairs.unionByName(met).distinct()
    return pairs


VERIFIED = "a bigint, b bigint, common bigint, size_a bigint, size_b bigint"
_VERIFIED_ARROW = pa.schema([(c, pa.int64()) for c in ("a", "b", "common", "size_a", "size_b")])


def verified(pairs: DataFrame, feats: DataFrame) -> DataFrame:
    """pairs(a, b) with the exact numbers of distinct stretches in common and on either side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for batch in batches:
            rows = []
            for a, b, pa_, pb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "packed_a", "packed_b")), strict=True):
                if a != last:
                    last, mine = a, st.distinct(st.unpack(pa_))
                other = st.distinct(st.unpack(pb))
                rows.append((a, b, st.shared(mine, other), len(mine), len(other)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_VERIFIED_ARROW)

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("tid")).distinct()
    texts = feats.filter("tid IS NOT NULL").select("tid", "packed").join(wanted, "tid", "left_semi").dropDuplicates(["tid"])
    texts = materialize(texts, "texts")
    full = pairs.join(texts.select(F.col("tid").alias("b"), F.col("packed").alias("packed_b")), "b")
    full = full.join(texts.select(F.col("tid").alias("a"), F.col("packed").alias("packed_a")), "a")
    return map_arrow(full.sortWithinPartitions("a"), run, VERIFIED)
