"""Problem 6: a sample whose shares per category follow targets, with minima, and what falls short.

Where minima raise some quotas above their share, the others shrink alike, so that the size stays the given one.
Controlled rounding: the fractional quotas of a two-way table (label by source) are made integer by a
maximal flow with lower bounds, so that each cell, row, column and the total is its value rounded down or up.
Each cell then gives exactly its quota, the records with the least random keys: a histogram of
the keys' leading bits finds the cut of each cell, and only the bin at the cut is ranked.

Defined cases: a record is counted once per id, with its greatest label and source if its rows differ; records
without label or source are not in the pool; sources are compared trimmed and in lower case; a
category that the pool can't fill gives all it has and is reported; an empty pool gives an empty sample.
"""

from __future__ import annotations

import math
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windrow.llm.tables import tidy
from windrow.ship import map_groups
from windrow.storage import materialize

#: Leading bits of a random key that are counted to find the cuts.
KEY_BITS = 12


def _max_flow(n: int, edges: list[list[int]], source: int, sink: int) -> int:
    """Shortest augmenting paths; edges are [from, to, room] and hold the room left afterwards."""
    out: list[list[int]] = [[] for _ in range(n)]
    for i, (a, _, _) in enumerate(edges):
        out[a].append(i)
    total = 0
    while True:
        by = {source: -1}
        queue = deque([source])
        while queue and sink not in by:
            for i in out[queue.popleft()]:
                if edges[i][2] > 0 and edges[i][1] not in by:
                    by[edges[i][1]] = i
                    queue.append(edges[i][1])
        if sink not in by:
            return total
        path, at = [], sink
        while at != source:
            path.append(by[at])
            at = edges[by[at]][0]
        push = min(edges[i][2] for i in path)
        for i in path:
            edges[i][2] -= push
            edges[i ^ 1][2] += push  # edges lie in pairs, forth and back
        total += push


def controlled_rounding(cells: dict[tuple, float]) -> dict[tuple, int]:
    """Integers for the cells (row, column) of a table: every cell, margin and the total is rounded down or up."""
    if not cells:
        return {}
    low = lambda x: math.floor(x + 1e-9)
    high = lambda x: math.ceil(x - 1e-9)
    rows, columns = sorted({r for r, _ in cells}, key=str), sorted({c for _, c in cells}, key=str)
    node = {("r", r): i + 4 for i, r in enumerate(rows)} | {("c", c): i + 4 + len(rows) for i, c in enumerate(columns)}
    start, end, extra_start, extra_end = 0, 1, 2, 3
    bounds = [(start, node["r", r], sum(v for (a, _), v in cells.items() if a == r)) for r in rows]
    bounds += [(node["c", c], end, sum(v for (_, b), v in cells.items() if b == c)) for c in columns]
    bounds += [(node["r", r], node["c", c], v) for (r, c), v in cells.items()]
    bounds += [(end, start, sum(cells.values()))]
    edges: list[list[int]] = []
    need = 0
    for a, b, v in bounds:
        edges += [[a, b, high(v) - low(v)], [b, a, 0]]
    for a, b, v in bounds:
        if low(v):
            edges += [[extra_start, b, low(v)], [b, extra_start, 0], [a, extra_end, low(v)], [extra_end, a, 0]]
            need += low(v)
    if _max_flow(len(node) + 4, edges, extra_start, extra_end) != need:
        raise RuntimeError("the table can't be rounded")  # can't happen: the fractional table is a flow
    first = len(rows) + len(columns)
    return {k: low(v) + high(v) - low(v) - edges[2 * (first + i)][2] for i, (k, v) in enumerate(cells.items())}


def _pool(df: DataFrame, id_col: str, label_col: str, source_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(label_col).cast("int").alias("label"), tidy(source_col).alias("source"))
    rows = rows.filter("id IS NOT NULL AND label IS NOT NULL AND source IS NOT NULL")
    # one of the rows of an id, not the greatest label and the greatest source of different rows
    return rows.groupBy("id").agg(F.max(F.struct("label", "source")).alias("at")).select("id", "at.label", "at.source")


def scaled_wants(shares: list[float], minima: list[float], size: int) -> list[float]:
    """max(minimum, scale * share * size) with the scale, at most 1, that makes the sum size if it can be."""
    at = lambda scale: [max(float(m), scale * s * size) for s, m in zip(shares, minima, strict=True)]
    if sum(at(1.0)) <= size:
        return at(1.0)
    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if sum(at(middle)) > size else (middle, high)
    return at(low)


_QUOTAS = "label int, source string, target_share double, min_rows bigint, pool_rows bigint, wanted double, quota bigint, short boolean"


def _quotas(fraction: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        size = math.floor(fraction * pdf["n"].sum())
        pdf = pdf[pdf["target_share"].notna()].copy()
        pdf["pool_rows"] = pdf["n"].astype("int64")
        pdf["wanted"] = [max(float(m), s * size) for m, s in zip(pdf["min_rows"], pdf["target_share"], strict=True)]
        pdf["short"] = pdf["pool_rows"] < pdf["wanted"]
        wants = scaled_wants(pdf["target_share"].tolist(), pdf["min_rows"].tolist(), size)
        cells = {(r, c): min(float(p), w) for r, c, p, w in zip(pdf["label"], pdf["source"], pdf["pool_rows"], wants, strict=True)}
        whole = controlled_rounding(cells)
        pdf["quota"] = [whole[r, c] for r, c in zip(pdf["label"], pdf["source"], strict=True)]
        return pdf[["label", "source", "target_share", "min_rows", "pool_rows", "wanted", "quota", "short"]]

    return run


def quota_table(pool: DataFrame, targets: DataFrame, fraction: float) -> DataFrame:
    """The rows of targets(label, source, target_share, min_rows) with what the pool has, the wanted rows and the integer quota."""
    goal = targets.select(F.col("label").cast("int").alias("label"), tidy("source").alias("source"), "target_share", F.col("min_rows").cast("bigint").alias("min_rows"))
    goal = goal.filter("label IS NOT NULL AND source IS NOT NULL AND target_share IS NOT NULL").groupBy("label", "source").agg(F.max("target_share").alias("target_share"), F.max(F.coalesce("min_rows", F.lit(0))).alias("min_rows"))
    counts = pool.groupBy("label", "source").agg(F.count("*").alias("n"))
    both = counts.join(goal, ["label", "source"], "full")
    aimed = F.col("target_share").isNotNull()
    # all categories without a target become one row: only their number counts
    both = both.groupBy(F.when(aimed, F.col("label")).alias("label"), F.when(aimed, F.col("source")).alias("source")).agg(
        F.max("target_share").alias("target_share"), F.max("min_rows").alias("min_rows"), F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    return map_groups(both.withColumn("one", F.lit(1)), ["one"], _quotas(fraction), _QUOTAS)


def quota_sample(df: DataFrame, targets: DataFrame, fraction: float = 0.25, seed: int = 7, id_col: str = "segment_id", label_col: str = "label", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The sample (id, label, source) and the report per category with the rows sampled."""
    pool = materialize(_pool(df, id_col, label_col, source_col), "pool")
    quotas = materialize(quota_table(pool, targets, fraction), "quotas")
    key = F.xxhash64(F.lit(seed), F.col("id"))
    keyed = pool.join(quotas.select("label", "source", "quota"), ["label", "source"]).withColumn("key", key)
    keyed = keyed.withColumn("bin", F.shiftrightunsigned("key", 64 - KEY_BITS))
    bins = keyed.groupBy("label", "source", "quota", "bin").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("label", "source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).filter("before < quota")
    cut = bins.select("label", "source", "bin", (F.col("quota") - F.col("before")).alias("left"), (F.col("before") + F.col("n") <= F.col("quota")).alias("whole"))
    near = keyed.drop("quota").join(cut, ["label", "source", "bin"])
    taken = near.filter("whole").select("id", "label", "source")
    ranked = near.filter("NOT whole").withColumn("rank", F.row_number().over(Window.partitionBy("label", "source", "bin").orderBy("key", "id")))
    sample = taken.unionByName(ranked.filter("rank <= left").select("id", "label", "source"))
    sample = materialize(sample.withColumnRenamed("id", id_col), "sample")
    got = sample.groupBy("label", "source").agg(F.count("*").alias("sampled"))
    report = quotas.join(got, ["label", "source"], "left").withColumn("sampled", F.coalesce("sampled", F.lit(0)))
    return sample, report
