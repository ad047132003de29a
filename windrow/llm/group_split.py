"""Problem 5: assign records to splits in given shares so that related records lie together.

Largest-differencing balance. Groups of related records have a weight per label. In each of many
tasks the weights, as tuples of BINS bins, are combined two at a time, always those with the
largest differences, the heaviest bin of one with the lightest of the other. The tasks' tuples are
combined in the same manner up a tree with FAN leaves a node, so no task sees more than a
bounded number of rows. The BINS nearly equal bins that are left go whole to the splits.

Defined cases: records without a label are left out; a group heavier than a split goes to the split with the
greatest share, and the report shows the shares reached; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from windrow.ship import map_groups
from windrow.storage import materialize

BINS = 100
#: Groups that a task balances at the first level, and tuples that are combined at the others.
LEAF, FAN = 4096, 64
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: Most labels that shares are kept for.
MAX_LABELS = 64


def largest_differencing(tuples: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Combine tuples, each an array of bins by labels, into one; also, for each tuple, the bin that each of its bins went to."""
    if not tuples:
        return np.zeros((0, 0)), []
    tick = count()
    heap = []
    for i, t in enumerate(tuples):
        total = t.sum(axis=1)
        order = np.argsort(-total, kind="stable")
        heap.append((-(total[order[0]] - total[order[-1]]), next(tick), t[order], [(i, order)]))
    heapq.heapify(heap)
    # an entry's last item: its parts, each with the bin of the part that lies in each of its own bins
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        both = a + b[::-1]
        total = both.sum(axis=1)
        order = np.argsort(-total, kind="stable")
        mine, other = order, len(order) - 1 - order
        heapq.heappush(heap, (-(total[order[0]] - total[order[-1]]), next(tick), both[order], [(in_a, mine), (in_b, other)]))
    _, _, bins, tree = heap[0]
    where: list[np.ndarray] = [np.empty(0, np.int64)] * len(tuples)
    stack = [(tree, np.arange(len(bins)))]
    while stack:
        members, now = stack.pop()  # now[b]: which bin of the node lies in final bin b
        for child, order in members:
            at = order[now]
            if isinstance(child, int):
                to = np.empty(len(at), np.int64)
                to[at] = np.arange(len(at))
                where[child] = to
            else:
                stack.append((child, at))
    return bins, where


def _balance(parent: str):
    """Balance all tuples of a node of the tree; rows are (node, child, bin, weight)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        labels = len(pdf["weight"].iloc[0])
        pdf = pdf.sort_values(["child", "bin"])
        tuples, keys = [], []
        for child, rows in pdf.groupby("child", sort=True):
            t = np.zeros((BINS, labels))
            t[rows["bin"].to_numpy()] = np.stack(rows["weight"].to_numpy())
            tuples.append(t)
            keys.append(child)
        bins, where = largest_differencing(tuples)
        place = {k: w for k, w in zip(keys, where, strict=True)}
        out = pdf[["node", "child", "bin"]].copy()
        out["to_bin"] = [int(place[c][b]) for c, b in zip(pdf["child"], pdf["bin"], strict=True)]
        out["weight"] = [bins[b].tolist() for b in out["to_bin"]]
        return out

    return run


_PLACED = "node bigint, child string, bin int, to_bin int, weight array<double>"


def allocate_bins(weights: np.ndarray, shares: list[float]) -> np.ndarray:
    """For each bin (rows: bins, columns: labels) the split it goes to: nearest to the shares of every label."""
    n, labels = weights.shape
    totals = weights.sum(axis=0)
    scale = np.where(totals > 0, totals, 1)
    w = weights / scale
    target = np.outer(shares, (totals > 0).astype(float))
    now = np.zeros_like(target)
    to = np.zeros(n, np.int64)
    for i in np.argsort(-w.sum(axis=1), kind="stable"):
        room = [np.abs(target - now - np.eye(len(shares))[:, [s]] * w[i]).sum() for s in range(len(shares))]
        to[i] = int(np.argmin(room))
        now[to[i]] += w[i]

    def cost(x):
        return ((x - target) ** 2).sum()

    best = cost(now)
    for _ in range(20 * n):
        change = None
        for i in range(n):
            for s in range(len(shares)):
                if s == to[i]:
                    continue
                moved = now.copy()
                moved[to[i]] -= w[i]
                moved[s] += w[i]
                if (c := cost(moved)) < best - 1e-12:
                    best, change = c, [(i, s)]
        for i in range(n):  # swaps
            others = np.flatnonzero(to != to[i])
            others = others[others > i]
            if not len(others):
                continue
            d = w[others] - w[i]
            a = now[to[i]] - target[to[i]]
            b = now[to[others]] - target[to[others]]
            delta = ((a + d) ** 2 - a**2).sum(axis=1) + ((b - d) ** 2 - b**2).sum(axis=1)
            k = int(np.argmin(delta))
            c = cost(now) + delta[k]
            if c < best - 1e-12:
                best, change = c, [(i, to[others[k]]), (int(others[k]), to[i])]
        if change is None:
            break
        for i, s in change:
            now[to[i]] -= w[i]
            now[s] += w[i]
            to[i] = s
        best = cost(now)
    return to


def _allocated(names: list[str], shares: list[float]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        to = allocate_bins(np.stack(pdf["weight"].to_numpy()), shares)
        return pd.DataFrame({"bin": pdf["bin"], "split": [names[t] for t in to]})

    return run


def group_split(records: DataFrame, shares: dict[str, float] = SHARES) -> DataFrame:
    """records(segment_id, label, group_id) with a column split; all records of a group have the same."""
    spark = records.sparkSession
    records = materialize(records.select("segment_id", "label", "group_id"), "grouped")
    labels = sorted(r["label"] for r in records.select("label").distinct().limit(MAX_LABELS + 1).collect())
    if len(labels) > MAX_LABELS:
        raise ValueError(f"shares are kept for at most {MAX_LABELS} labels")
    if not labels:
        return records.withColumn("split", F.lit(None).cast("string"))
    per = F.array(*(F.count_if(F.col("label") == v).cast("double") for v in labels))
    groups = records.groupBy("group_id").agg(per.alias("weight"))
    groups = materialize(groups, "groups")
    leaves = max(1, -(-groups.count() // LEAF))
    level = groups.select(F.pmod(F.xxhash64("group_id"), F.lit(leaves)).alias("node"), F.col("group_id").alias("child"), F.lit(0).alias("bin"), "weight")
    placed = materialize(map_groups(level, ["node"], _balance("leaf"), _PLACED), "placed")
    at = placed.select(F.col("child").alias("group_id"), "node", F.col("to_bin").alias("bin"))
    while leaves > 1:
        tuples = placed.groupBy("node", F.col("to_bin").alias("bin")).agg(F.first("weight").alias("weight"))
        up = tuples.select(F.floor(F.col("node") / F.lit(FAN)).alias("node"), F.col("node").cast("string").alias("child"), "bin", "weight")
        placed = materialize(map_groups(up, ["node"], _balance("node"), _PLACED), "placed")
        step = placed.select(F.col("child").cast("bigint").alias("node"), "bin", F.col("node").alias("_node"), F.col("to_bin").alias("_bin"))
        at = at.join(step, ["node", "bin"]).select("group_id", F.col("_node").alias("node"), F.col("_bin").alias("bin"))
        leaves = -(-leaves // FAN)
    # a bin into which nothing fell has no row and no weight
    bins = placed.groupBy(F.col("to_bin").alias("bin")).agg(F.first("weight").alias("weight")).withColumn("one", F.lit(1))
    to = map_groups(bins.orderBy("bin"), ["one"], _allocated(list(shares), list(shares.values())), "bin int, split string")
    chosen = at.join(to, "bin").select("group_id", "split")
    return records.join(chosen, "group_id").select("segment_id", "label", "group_id", "split")


def split_report(assigned: DataFrame, shares: dict[str, float] = SHARES) -> DataFrame:
    """(split, label, records, share, target_share): shares of each label that the splits got."""
    spark = assigned.sparkSession
    counts = assigned.groupBy("label", "split").agg(F.count("*").alias("records"), F.countDistinct("group_id").alias("groups"))
    totals = counts.groupBy("label").agg(F.sum("records").alias("total"))
    target = spark.createDataFrame([Row(split=k, target_share=v) for k, v in shares.items()])
    full = totals.withColumn("split", F.explode(F.array(*map(F.lit, shares)))).join(target, "split")
    out = full.join(counts, ["label", "split"], "left")
    n = F.coalesce("records", F.lit(0))
    return out.select("split", "label", n.alias("records"), F.coalesce("groups", F.lit(0)).alias("groups"), (n / F.col("total")).alias("share"), "target_share")
