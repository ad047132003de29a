"""Ordered signals along a sequence: collapse, normalise, smooth, threshold, regions, grid search.

Where a window function has to pass a whole key, the key is a genome or contig of one model. The
recurrence of exponential smoothing runs in grouped pandas; everything else is built in.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.operators.metrics import rates
from windrow.ship import with_run_columns
from windrow.storage import materialize


def collapse(df: DataFrame, keys: list[str], step: int = 1000, strict_majority: bool = True) -> DataFrame:
    """Overlapping windows (start, end, score, pred, label) into bins of step bases: (keys, start, end, score, pred, label, windows).

    Bins begin at the least start of the key; the last is clipped at the greatest end. A window counts for
    the bins it covers wholly. score is the mean, pred the majority (a tie is 0, or 1 without strict_majority), label that of the first window.
    Each window is exploded into its few bins and these are aggregated by hash.
    """
    rows = df.filter("start IS NOT NULL AND end IS NOT NULL AND start < end")
    span = rows.groupBy(*keys).agg(F.min("start").alias("_lo"), F.max("end").alias("_hi"))
    rows = rows.join(span, keys)
    first = F.ceil((F.col("start") - F.col("_lo")) / F.lit(step))
    last = F.floor((F.col("end") - F.col("_lo")) / F.lit(step)) - 1
    clipped = F.floor((F.col("_hi") - 1 - F.col("_lo")) / F.lit(step))
    last = F.when(F.col("end") == F.col("_hi"), clipped).otherwise(last)
    rows = rows.withColumn("_first", first.cast("bigint")).withColumn("_last", last.cast("bigint")).filter("_first <= _last")
    rows = rows.withColumn("_k", F.explode(F.sequence("_first", "_last")))
    twice = 2 * F.sum("pred")
    majority = twice > F.count("pred") if strict_majority else (twice >= F.count("pred")) & (F.count("pred") > 0)
    binned = rows.groupBy(*keys, "_k", "_lo", "_hi").agg(
        F.avg("score").alias("score"), majority.cast("int").alias("pred"),
        F.min_by("label", F.struct("start", "end", "segment_id")).alias("label"), F.count("*").alias("windows"),
    )
    start = F.col("_lo") + F.col("_k") * step
    return binned.select(*keys, start.alias("start"), F.least(start + step, "_hi").alias("end"), "score", F.coalesce("pred", F.lit(0)).alias("pred"), "label", "windows")


NORMALS = ("zscore", "robust", "median", "minmax", "iqr", "rank")


def normalize(df: DataFrame, keys: list[str], value: str, method: str, scale: float = 1.0) -> DataFrame:
    """df with the column normal. zscore: population deviation, 0 where it is 0; robust: mad times scale, deviation from the median where it is 0;
    median: deviation from the median; minmax: 0 where all are equal; iqr: deviation from the median where it is 0; rank: mean rank of ties over the number.
    """
    v, per = F.col(value), Window.partitionBy(*keys)
    if method == "rank":
        below = F.rank().over(per.orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / F.lit(2.0)
        return df.withColumn("normal", F.when(v.isNotNull(), below / F.count(v).over(per)))
    if method == "zscore":
        mean, sd = F.avg(v).over(per), F.stddev_pop(v).over(per)
        return df.withColumn("normal", F.when(sd > 0, (v - mean) / sd).otherwise(v * 0.0))
    if method == "minmax":
        low, high = F.min(v).over(per), F.max(v).over(per)
        return df.withColumn("normal", F.when(high > low, (v - low) / (high - low)).otherwise(v * 0.0))
    q = df.groupBy(*keys).agg(F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    out = df.join(q, keys)
    off = v - F.col("_q")[1]
    if method == "median":
        return out.withColumn("normal", off).drop("_q")
    if method == "iqr":
        iqr = F.col("_q")[2] - F.col("_q")[0]
        return out.withColumn("normal", F.when(iqr > 0, off / iqr).otherwise(off)).drop("_q")
    if method == "robust":
        mad = out.groupBy(*keys).agg(F.percentile(F.abs(off), 0.5).alias("_mad"))
        m = F.col("_mad") * F.lit(scale)
        return out.join(mad, keys).withColumn("normal", F.when(m > 0, off / m).otherwise(off)).drop("_q", "_mad")
    raise ValueError(f"method must be one of {', '.join(NORMALS)}")


def _decayed(x: np.ndarray, weight: float, block: int = 64) -> np.ndarray:
    """y[i] = y[i - 1] + weight * (x[i] - y[i - 1]) from y[0] = x[0].

    Within a block the values' parts are one matrix product; what comes from before a block is one number, carried on.
    """
    keep, n = 1 - weight, len(x)
    rows = np.append(x, np.zeros(-n % block)).reshape(-1, block)
    age = np.subtract.outer(np.arange(block), np.arange(block))
    own = rows @ np.where(age >= 0, weight * keep ** np.maximum(age, 0), 0.0).T
    carry, before = np.empty(len(rows)), x[0]
    for i, last in enumerate(own[:, -1]):
        carry[i] = before
        before = last + keep**block * before
    return (own + carry[:, None] * keep ** np.arange(1, block + 1)).ravel()[:n]


def ewm_both_ways(values: np.ndarray, span: int) -> np.ndarray:
    """Mean of the exponential smoothing forwards and backwards, weight 2/(span+1); a span up to 1 changes nothing. Missing values stay missing and weigh nothing."""
    known = ~np.isnan(values)
    if span <= 1 or not known.any():
        return values
    x, out = values[known], np.full(len(values), np.nan)
    out[known] = (_decayed(x, 2 / (span + 1)) + _decayed(x[::-1], 2 / (span + 1))[::-1]) / 2
    return out


def smooth(df: DataFrame, keys: list[str], order: str, value: str, span: int, name: str = "smooth") -> DataFrame:
    """df with its values smoothed in both directions along order, per key."""
    return with_run_columns(df, keys, [order], value, lambda v: [ewm_both_ways(v, span)], [name])


def _islands(rows: DataFrame, keys: list[str], new: Column, order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_new", new).withColumn("_island", F.sum(F.coalesce(F.col("_new").cast("int"), F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def regions(df: DataFrame, keys: list[str], gap: int, smallest: int = 0, running: bool = True, score: str = "score") -> DataFrame:
    """Positive windows (start, end) joined into regions where the gap to the ends before is at most gap, then filtered by size.

    running compares with the greatest end so far, else with the end of the window before. (keys, start, end, size, windows, avg_score)
    """
    order = ["start", "end"]
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)) if running else F.lag("end").over(w)
    rows = _islands(df.filter("start IS NOT NULL AND end IS NOT NULL"), keys, F.col("start") - before > gap, order)
    last = F.max("end") if running else F.max_by("end", F.struct("start", "end"))
    out = rows.groupBy(*keys, "_island").agg(F.min("start").alias("start"), last.alias("end"), F.count("*").alias("windows"), F.avg(score).alias("avg_score"))
    return out.select(*keys, "start", "end", (F.col("end") - F.col("start")).alias("size"), "windows", "avg_score").filter(F.col("size") >= smallest)


def position_clusters(df: DataFrame, keys: list[str], position: str, gap: int, least: int = 1) -> DataFrame:
    """Positions at most gap apart in clusters of at least least positions: (keys, first, last, size, positions)."""
    w = Window.partitionBy(*keys).orderBy(position)
    rows = _islands(df, keys, F.col(position) - F.lag(position).over(w) > gap, [position])
    out = rows.groupBy(*keys, "_island").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("positions"))
    return out.select(*keys, "first", "last", (F.col("last") - F.col("first")).alias("size"), "positions").filter(F.col("positions") >= least)


def true_runs(df: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """Unbroken runs of rows with flag 1 along order: (keys, first, last, rows)."""
    rows = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    rows = rows.filter(F.col(flag) == 1).withColumn("_run", F.col("_n") - F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return rows.groupBy(*keys, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("rows")).drop("_run")


def centred(keys: list[str], order: str, width: int):
    """The frame of width rows around a row; for even widths one more before than after."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(-(width // 2), (width - 1) // 2)


def rolling(df: DataFrame, keys: list[str], order: str, value: str, width: int) -> DataFrame:
    """df with rolling sum, mean and median over a centred frame; frames at the ends are shorter."""
    w = centred(keys, order, width)
    return df.withColumns({"rolling_sum": F.sum(value).over(w), "rolling_mean": F.avg(value).over(w), "rolling_median": F.percentile(value, 0.5).over(w)})


def _kth_distance(ordered: list[float], middle: float, k: int) -> float:
    """The k-th least (from 0) of the distances of sorted values to middle: those below and those above it are sorted runs, searched by halving."""
    split = bisect_left(ordered, middle)
    low, high = max(0, k + 1 - (len(ordered) - split)), min(k + 1, split)  # how many of the k + 1 nearest lie below
    while low < high:
        below = (low + high) // 2
        if middle - ordered[split - 1 - below] < ordered[split + k - below] - middle:
            low = below + 1
        else:
            high = below
    return max(middle - ordered[split - low] if low else 0.0, ordered[split + k - low] - middle if k >= low else 0.0)


def _medians(v: np.ndarray, width: int) -> list[np.ndarray]:
    """Median and mad of the frame of each row: a sorted window takes in and gives up one value a row. Missing values are in no frame."""
    before, after = width // 2, (width - 1) // 2
    middle, spread, ordered = np.full(len(v), np.nan), np.full(len(v), np.nan), []
    for x in v[:after].tolist():
        if x == x:
            insort(ordered, x)
    for i in range(len(v)):
        if i + after < len(v) and (x := float(v[i + after])) == x:
            insort(ordered, x)
        if i - before > 0 and (x := float(v[i - before - 1])) == x:
            del ordered[bisect_left(ordered, x)]
        if n := len(ordered):
            middle[i] = (ordered[(n - 1) // 2] + ordered[n // 2]) / 2
            spread[i] = (_kth_distance(ordered, middle[i], (n - 1) // 2) + _kth_distance(ordered, middle[i], n // 2)) / 2
    return [middle, spread]


def rolling_mad(df: DataFrame, keys: list[str], order: str, value: str, width: int) -> DataFrame:
    """df with the median and the median absolute deviation of each centred frame; each frame has its own median."""
    return with_run_columns(df, keys, [order], value, lambda v: _medians(v, width), ["rolling_median", "rolling_mad"])


def moving_average(df: DataFrame, keys: list[str], order: str, value: str, width: int, stride: int = 1) -> DataFrame:
    """Means of whole frames of width rows only, every stride-th: (keys, order, average)."""
    w = Window.partitionBy(*keys).orderBy(order)
    full = w.rowsBetween(0, width - 1)
    rows = df.withColumns({"average": F.avg(value).over(full), "_n": F.count(F.lit(1)).over(full), "_i": F.row_number().over(w) - 1})
    return rows.filter((F.col("_n") == width) & (F.pmod("_i", F.lit(stride)) == 0)).select(*keys, order, "average")


def adaptive_thresholds(df: DataFrame, keys: list[str], value: str, k: float = 3.0, percent: float = 0.95) -> DataFrame:
    """Per key: median + k scaled mads, mean + k population deviations, and a percentile."""
    v = F.col(value)
    first = df.groupBy(*keys).agg(F.percentile(v, 0.5).alias("_median"), (F.avg(v) + k * F.stddev_pop(v)).alias("by_deviation"), F.percentile(v, percent).alias("by_percentile"))
    mad = df.join(first.select(*keys, "_median"), keys).groupBy(*keys).agg(F.percentile(F.abs(v - F.col("_median")), 0.5).alias("_mad"))
    return first.join(mad, keys).select(*keys, (F.col("_median") + k * 1.4826 * F.col("_mad")).alias("by_mad"), "by_deviation", "by_percentile")


def max_track(df: DataFrame, keys: list[str], bin_size: int) -> DataFrame:
    """Overlapping windows (start, end, score) as one track of bins with the greatest score of the windows that touch each: (keys, bin, peak)."""
    rows = df.filter("start IS NOT NULL AND end IS NOT NULL AND start < end AND score IS NOT NULL")
    k = F.sequence(F.floor(F.col("start") / F.lit(bin_size)), F.floor((F.col("end") - 1) / F.lit(bin_size)))
    return rows.withColumn("bin", F.explode(k)).groupBy(*keys, "bin").agg(F.max("score").alias("peak"))


def mask_window_edges(position: Column, step: int = 49_000, edge: int = 10) -> Column:
    """True for the first positions of every window after the first."""
    return (position >= step) & (F.pmod(position, F.lit(step)) < edge)


#: Weights of (greatest, mean, share) in the combined scores.
COMBINATIONS = {
    "max_only": (1.0, 0.0, 0.0), "mean_only": (0.0, 1.0, 0.0), "fraction_only": (0.0, 0.0, 1.0), "equal_weight": (1 / 3, 1 / 3, 1 / 3),
    "max_heavy": (0.6, 0.2, 0.2), "mean_heavy": (0.2, 0.6, 0.2), "max_mean": (0.5, 0.5, 0.0),
}


def combined_scores(df: DataFrame, keys: list[str], columns: tuple[str, str, str]) -> DataFrame:
    """df with a column per combination: weighted sums of the three columns, each scaled to 0..1 per key."""
    per = Window.partitionBy(*keys)

    def unit(c: str) -> Column:
        low, high = F.min(c).over(per), F.max(c).over(per)
        return F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(0.0)

    scaled = df.withColumns({f"_{i}": unit(c) for i, c in enumerate(columns)})
    out = scaled.withColumns({name: sum((F.col(f"_{i}") * w for i, w in enumerate(ws) if w), F.lit(0.0)) for name, ws in COMBINATIONS.items()})
    return out.drop("_0", "_1", "_2")


def grid_search(bins: DataFrame, keys: list[str], unit: str, thresholds: list[float], gaps: list[int], sizes: list[int], value: str = "score") -> DataFrame:
    """All combinations of threshold, gap and smallest region over bins(start, end, label, value): counts, micro and macro rates.

    Each threshold's positive bins are joined into regions per gap once; the sizes only filter regions. True and
    false positives are sums over kept regions; the negatives follow from totals that no parameter changes.
    """
    per = [*keys, unit]
    rows = bins.filter("start IS NOT NULL AND end IS NOT NULL")
    totals = rows.groupBy(*per).agg(F.count_if(F.col("label") == 1).alias("_p"), F.count_if(F.col("label") == 0).alias("_n"))
    lit = lambda xs: F.explode(F.array(*map(F.lit, xs)))
    hits = rows.filter(F.col(value) >= min(thresholds)).withColumn("threshold", lit([float(t) for t in thresholds])).filter(F.col(value) >= F.col("threshold"))
    hits = hits.withColumn("gap", lit([int(g) for g in gaps]))
    group = [*per, "threshold", "gap"]
    w = Window.partitionBy(*group).orderBy("start", "end")
    hits = _islands(hits, group, F.col("start") - F.lag("end").over(w) > F.col("gap"), ["start", "end"])
    found = hits.groupBy(*group, "_island").agg((F.max("end") - F.min("start")).alias("size"), F.count_if(F.col("label") == 1).alias("tp"), F.count_if(F.col("label") == 0).alias("fp"))
    found = found.withColumn("smallest", lit([int(s) for s in sizes])).filter("size >= smallest")
    kept = found.groupBy(*group, "smallest").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    grid = totals.withColumn("threshold", lit([float(t) for t in thresholds])).withColumn("gap", lit([int(g) for g in gaps])).withColumn("smallest", lit([int(s) for s in sizes]))
    full = grid.join(kept, [*group, "smallest"], "left").fillna(0, ["tp", "fp"])
    full = rates(full.select(*per, "threshold", "gap", "smallest", "tp", (F.col("_n") - F.col("fp")).alias("tn"), "fp", (F.col("_p") - F.col("tp")).alias("fn")))
    params = [*keys, "threshold", "gap", "smallest"]
    macro = {f"macro_{c}": F.avg(F.coalesce(c, F.lit(0.0))) for c in ("mcc", "precision", "recall", "f1")}
    out = full.groupBy(*params).agg(F.count("*").alias("genomes"), *(F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn")), *(v.alias(k) for k, v in macro.items()))
    return rates(out).select(*params, "genomes", "tp", "tn", "fp", "fn", *macro, F.col("mcc").alias("micro_mcc"))


def grid_search_signals(bins: DataFrame, keys: list[str], unit: str, methods: list[str], spans: list[int], thresholds: list[float], gaps: list[int], sizes: list[int], value: str = "score", digits: int = 9) -> DataFrame:
    """grid_search over normalised and smoothed signals too: every method of normalize ('none' for the value itself) with every span.

    Each normalised signal and each of its smoothings is computed once per key and unit; thresholds, gaps and sizes are swept over all of them together.
    Signals are rounded to digits, so that a threshold doesn't hang on the order of a sum.
    """
    per = [*keys, unit]
    rows = bins.filter("start IS NOT NULL AND end IS NOT NULL").select(*per, "start", "end", "label", F.col(value).alias("_v"))
    rows, out = materialize(rows, "bins"), None
    for method in methods:
        normal = rows.withColumn("normal", F.col("_v")) if method == "none" else normalize(rows, per, "_v", method)
        normal = normal.select(*per, "start", "end", "label", "normal", F.lit(method).alias("method"))
        smoothed = with_run_columns(normal, per, ["start"], "normal", lambda v: [ewm_both_ways(v, s) for s in spans], [f"_s{s}" for s in spans])
        out = smoothed if out is None else out.unionByName(smoothed)
    signals = F.explode(F.array(*(F.struct(F.lit(int(s)).alias("span"), F.round(f"_s{s}", digits).alias("signal")) for s in spans)))
    long = out.withColumn("_x", signals).select(*per, "start", "end", "label", "method", "_x.span", "_x.signal")
    return grid_search(materialize(long, "signals"), [*keys, "method", "span"], unit, thresholds, gaps, sizes, "signal")


def best_per_key(df: DataFrame, keys: list[str], metric: str, order: list[str]) -> DataFrame:
    """The row with the greatest metric per key; the first by order on ties."""
    w = Window.partitionBy(*keys).orderBy(F.desc(metric), *order)
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
