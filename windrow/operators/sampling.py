"""Sampling, splitting and allocation, all reproducible: the order is md5(key|seed), the same in any engine."""

from __future__ import annotations

import hashlib
import math
import random
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.ship import map_groups


def seeded(key: str | Column, seed: int) -> Column:
    """The random order key of a row."""
    return F.md5(F.concat(F.col(key).cast("string") if isinstance(key, str) else key, F.lit(f"|{seed}")))


def one_per_group(df: DataFrame, group: list[str], key: str, seed: int) -> DataFrame:
    """One random row per group, by an aggregate: no group is sorted."""
    rest = [c for c in df.columns if c not in group]
    best = F.min_by(F.struct(*rest), F.struct(seeded(key, seed), F.col(key)))
    return df.groupBy(*group).agg(best.alias("_r")).select(*group, *(F.col(f"_r.{c}").alias(c) for c in rest))


def capped(df: DataFrame, group: list[str], key: str, most: int, seed: int) -> DataFrame:
    """At most so many random rows per group."""
    w = Window.partitionBy(*group).orderBy(seeded(key, seed), key)
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most).drop("_k")


def take(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n random rows: a top-n, not a global sort."""
    return df.orderBy(seeded(key, seed), key).limit(n)


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """All rows in random order (a range-partitioned sort)."""
    return df.orderBy(seeded(key, seed), key)


def group_split(groups: DataFrame, key: str, seed: int, shares: tuple[float, float] = (0.8, 0.1)) -> DataFrame:
    """(key, split) of distinct keys in random order: the first int(n*a) train, the next int(n*b) dev, the rest test.

    Ranks come from counts per leading digits of the order key and a rank within each, so no task sorts all keys.
    """
    keys = groups.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_h", seeded(key, seed))
    keys = keys.withColumn("_b", F.substring("_h", 1, 3))
    per = keys.groupBy("_b").agg(F.count("*").alias("_n"))
    per = per.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_all"))
    own = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    ranked = keys.withColumn("_own", own).join(per, "_b").withColumn("_r", F.col("_before") + F.col("_own"))
    train = F.floor(F.col("_all") * shares[0])
    dev = train + F.floor(F.col("_all") * shares[1])
    return ranked.select(key, F.when(F.col("_r") <= train, "train").when(F.col("_r") <= dev, "dev").otherwise("test").alias("split"))


def even_allocation(groups: DataFrame, key: str, total: int, seed: int) -> DataFrame:
    """(key, n): total // groups each, and one more for the first total % groups in random order."""
    keys = groups.select(key).filter(F.col(key).isNotNull()).distinct()
    n = keys.count()
    if n == 0:
        return keys.withColumn("n", F.lit(0).cast("bigint"))
    more = take(keys, key, total % n, seed).select(key, F.lit(1).alias("_more")) if total % n else None
    out = keys.join(more, key, "left") if more is not None else keys.withColumn("_more", F.lit(0))
    return out.select(key, (F.lit(total // n) + F.coalesce("_more", F.lit(0))).cast("bigint").alias("n"))


def samples_per_length(length: str | Column, size: int, least: int) -> Column:
    """0 under least, 1 under size, else length // size."""
    n = F.col(length) if isinstance(length, str) else length
    return F.when(n < least, 0).when(n < size, 1).otherwise(F.floor(n / F.lit(size)))


def nonoverlapping_starts(length: int, n: int, size: int, key: str, seed: int) -> list[int]:
    """n random starts (or as many as fit) whose pieces of size bases don't overlap, sorted.

    The bases that no piece takes are dealt out: n sorted random places among them, each moved by the pieces before it. Every layout is equally likely.
    """
    n = min(n, length // size)
    rng = random.Random(int(hashlib.md5(f"{key}|{seed}".encode()).hexdigest()[:16], 16))
    places = sorted(rng.sample(range(length - n * size + n), n)) if n > 0 else []
    return [place + i * (size - 1) for i, place in enumerate(places)]


def random_segments(df: DataFrame, key: str, length: str, n: str, size: int, seed: int) -> DataFrame:
    """(key, segment_num, start, end): random segments of each key that don't overlap."""

    def run(batches):
        for pdf in batches:
            rows = []
            for k, total, wanted in zip(pdf["k"], pdf["length"], pdf["n"], strict=True):
                for i, s in enumerate(nonoverlapping_starts(int(total), int(wanted), size, k, seed)):
                    rows.append((k, i, s, s + size))
            yield pd.DataFrame(rows, columns=["k", "segment_num", "start", "end"])

    from windrow.ship import ship

    ship(df.sparkSession)
    rows = df.select(F.col(key).cast("string").alias("k"), F.col(length).cast("bigint").alias("length"), F.col(n).cast("bigint").alias("n")).filter("k IS NOT NULL AND length IS NOT NULL AND n > 0")
    return rows.mapInPandas(run, "k string, segment_num bigint, start bigint, end bigint").withColumnRenamed("k", key)


def proportional_allocation(counts: dict[str, int], total: int, repair: str = "largest") -> dict[str, int]:
    """Shares of total in proportion to counts, rounded down, at least 1 and at most what is there, repaired to the total.

    repair='largest': what is too much is taken from the largest shares, what is missing is dealt out in turn, the largest groups first.
    repair='smallest': what is too much is taken from the smallest shares above 1, what is missing goes to the largest group that has some left.
    With more groups than places the smallest groups get none. The total is at most the sum of counts.
    """
    order = sorted((k for k, c in counts.items() if c > 0), key=lambda k: (-counts[k], k))
    whole = sum(counts[k] for k in order)
    total = max(0, min(total, whole))
    order = order[:total]
    out = {k: min(counts[k], max(1, total * counts[k] // whole)) for k in order}
    place = {k: i for i, k in enumerate(order)}
    sign = -1 if repair == "largest" else 1
    over = [(sign * n, place[k], k) for k, n in out.items() if n > 1]
    heapify(over)
    for _ in range(sum(out.values()) - total):
        share, i, k = heappop(over)
        out[k] -= 1
        if out[k] > 1:
            heappush(over, (share - sign, i, k))
    missing = total - sum(out.values())
    while missing:
        for k in order:
            more = min(missing, counts[k] - out[k], 1 if repair == "largest" else missing)
            out[k] += more
            missing -= more
    return out


def allocated(counts: DataFrame, key: str, n: str, total: int, repair: str = "largest") -> DataFrame:
    """(key, n) by proportional_allocation over a table of groups, in one task: groups are few by nature (phyla)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = proportional_allocation(dict(zip(pdf["k"], pdf["c"].astype(int), strict=True)), total, repair)
        return pd.DataFrame({"k": list(got), "n": list(got.values())})

    rows = counts.select(F.col(key).cast("string").alias("k"), F.col(n).cast("bigint").alias("c"), F.lit(1).alias("one")).filter("k IS NOT NULL")
    return map_groups(rows, ["one"], run, "k string, n bigint").withColumnRenamed("k", key)


def spread_first(df: DataFrame, outer: str, inner: str, key: str, allocation: DataFrame, seed: int) -> DataFrame:
    """The allocated number of rows per outer group, from different inner groups first."""
    h = seeded(key, seed)
    rows = df.withColumn("_round", F.row_number().over(Window.partitionBy(outer, inner).orderBy(h, key)))
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(outer).orderBy("_round", h, key)))
    return rows.join(allocation.select(outer, F.col("n").alias("_n")), outer).filter("_k <= _n").drop("_round", "_k", "_n")


def coverage_segments(df: DataFrame, key: str, length: str, coverage: float, size: int, least: int, seed: int) -> DataFrame:
    """Random segments so that their bases are coverage times those of the sequences: (segment, key, start, end).

    ceil(coverage * sum / size) uniform places on all sequences laid end to end; each is in one sequence and runs to at most its end;
    those under least bases are dropped (short sequences count in the sum all the same). The places are joined with the sequences by blocks of the running length.
    """
    seqs = df.select(F.col(key), F.col(length).cast("bigint").alias("_len")).filter(F.col(key).isNotNull() & (F.col("_len") > 0))
    blocks = seqs.withColumn("_b", F.substring(F.md5(F.col(key).cast("string")), 1, 2))
    per = blocks.groupBy("_b").agg(F.sum("_len").alias("_s"))
    per = per.select("_b", (F.sum("_s").over(Window.orderBy("_b")) - F.col("_s")).alias("_base"))
    run = F.sum("_len").over(Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    laid = blocks.withColumn("_run", run).join(per, "_b").select(key, "_len", (F.col("_base") + F.col("_run") - F.col("_len")).alias("_from"), (F.col("_base") + F.col("_run")).alias("_to"))
    total = seqs.agg(F.coalesce(F.sum("_len"), F.lit(0))).first()[0]
    n = math.ceil(coverage * total / size)
    unit = F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(f"|{seed}"))), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
    places = df.sparkSession.range(n).select(F.col("id").alias("segment"), F.floor(unit * F.lit(float(total))).alias("_p"))
    block = 1 << 16
    laid = laid.withColumn("_k", F.explode(F.sequence(F.floor(F.col("_from") / block), F.floor((F.col("_to") - 1) / block))))
    hit = places.withColumn("_k", F.floor(F.col("_p") / block)).join(laid, "_k").filter("_p >= _from AND _p < _to")
    start = F.col("_p") - F.col("_from")
    out = hit.select("segment", key, start.alias("start"), F.least(start + size, "_len").alias("end"))
    return out.filter(F.col("end") - F.col("start") >= least)


def folds(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """df with the column fold: random, and equal in expectation; the same for rows of one key."""
    return df.withColumn("fold", F.pmod(F.conv(F.substring(seeded(key, seed), 1, 8), 16, 10).cast("bigint"), F.lit(k)).cast("int"))


def equal_folds(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """(key, fold) of distinct keys: shuffled, then dealt out in turn, so the folds differ by one key at most. Places come from ranges, not from one sort."""
    from windrow.operators.selection import placed

    keys = df.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_h", seeded(key, seed))
    return placed(keys, ["_h", key]).select(key, F.pmod("place", F.lit(k)).cast("int").alias("fold"))


def fold_splits(dealt: DataFrame, fold: int, column: str = "fold") -> DataFrame:
    """dealt with split: one fold is validation, the others are train."""
    return dealt.withColumn("split", F.when(F.col(column) == fold, "validation").otherwise("train"))


def masked(ids: str | Column, key: str | Column, seed: int, share: float = 0.15, mask_id: int = 4, vocabulary: int = 4101) -> Column:
    """A struct of masked token numbers and labels: of the chosen share 80 % are the mask, 10 % random, 10 % kept; -100 labels the others."""
    a = F.col(ids) if isinstance(ids, str) else ids
    k = F.col(key) if isinstance(key, str) else key

    def draw(i: Column, what: str) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws("|", k, i.cast("string"), F.lit(f"{what}{seed}"))), 1, 8), 16, 10).cast("double") / F.lit(float(16**8))

    chosen = lambda t, i: (t > 4) & (draw(i, "a") < share)
    swap = lambda t, i: F.when(draw(i, "b") < 0.8, F.lit(mask_id)).when(draw(i, "b") < 0.9, (5 + F.floor(draw(i, "c") * (vocabulary - 5))).cast("int")).otherwise(t)
    return F.struct(F.transform(a, lambda t, i: F.when(chosen(t, i), swap(t, i)).otherwise(t)).alias("ids"), F.transform(a, lambda t, i: F.when(chosen(t, i), t).otherwise(-100)).alias("labels"))
