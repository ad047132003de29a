"""Confusion counts and what follows from them, curves, sweeps, votes and aggregates over runs.

Counts are aggregated first (mergeable, so partial aggregation applies) and finished once; products of
counts are taken as doubles. Undefined ratios are null unless ``undefined`` says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COUNTS = ("tp", "tn", "fp", "fn")


def confusion(label: str = "label", pred: str = "pred") -> list[Column]:
    """tp, tn, fp, fn as aggregates. Rows without label or prediction count nowhere."""
    y, p = F.col(label), F.col(pred)
    return [F.count_if((y == a) & (p == b)).alias(name) for name, a, b in (("tp", 1, 1), ("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0))]


def _ratio(a: Column, b: Column, undefined: float | None) -> Column:
    return F.when(b != 0, a.cast("double") / b.cast("double")).otherwise(F.lit(undefined).cast("double"))


def rates(df: DataFrame, undefined: float | None = None) -> DataFrame:
    """accuracy, precision, recall, specificity, f1, fpr, fnr, balanced_accuracy, mcc and jaccard from tp, tn, fp, fn.

    mcc is 0 where it is undefined.
    """
    tp, tn, fp, fn = (F.col(c).cast("double") for c in COUNTS)
    den = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    recall, specificity = _ratio(tp, tp + fn, undefined), _ratio(tn, tn + fp, undefined)
    return df.withColumns({
        "accuracy": _ratio(tp + tn, tp + tn + fp + fn, undefined), "precision": _ratio(tp, tp + fp, undefined), "recall": recall, "specificity": specificity,
        "f1": _ratio(2 * tp, 2 * tp + fp + fn, undefined), "fpr": _ratio(fp, fp + tn, undefined), "fnr": _ratio(fn, fn + tp, undefined),
        "balanced_accuracy": (recall + specificity) / 2, "mcc": F.when(den > 0, (tp * tn - fp * fn) / F.sqrt(den)).otherwise(0.0), "jaccard": _ratio(tp, tp + fp + fn, undefined),
    })


def confusion_by(df: DataFrame, keys: list[str], label: str = "label", pred: str = "pred", undefined: float | None = None) -> DataFrame:
    """Counts and rates per keys (all rows where keys is empty)."""
    counted = df.groupBy(*keys).agg(F.count_if(F.col(label).isNotNull() & F.col(pred).isNotNull()).alias("n"), *confusion(label, pred))
    return rates(counted, undefined)


MEANS = ("mcc", "precision", "recall", "f1")


def micro_macro(df: DataFrame, keys: list[str], unit: str, label: str = "label", pred: str = "pred", skip_undefined: bool = True) -> DataFrame:
    """Per keys: pooled counts and rates (micro), and means over units (macro) of mcc, precision, recall and f1.

    Undefined values of a unit are skipped in the means or, with skip_undefined=False, count as 0.
    """
    per = confusion_by(df, [*keys, unit], label, pred)
    mean = (lambda c: F.avg(c)) if skip_undefined else (lambda c: F.avg(F.coalesce(c, F.lit(0.0))))
    out = per.groupBy(*keys).agg(F.count("*").alias("units"), *(F.sum(c).alias(c) for c in COUNTS), *(mean(F.col(c)).alias(f"macro_{c}") for c in MEANS))
    names = {c: f"micro_{c}" for c in ("accuracy", *MEANS)}
    full = rates(out)
    return full.select(*keys, "units", *COUNTS, *(F.col(a).alias(b) for a, b in names.items()), *(f"macro_{c}" for c in MEANS))


def roc_auc(df: DataFrame, keys: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """Tie-averaged area under the ROC curve per keys; null where only one class is there.

    The scores are counted per distinct value first, so the ordered pass sees values, not rows.
    """
    values = _by_value(df, keys, label, score)
    order = Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(order), F.lit(0))
    values = values.withColumn("won", F.col("pos").cast("double") * (below.cast("double") + F.col("neg") / F.lit(2.0)))
    out = values.groupBy(*keys).agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.sum("won").alias("won"))
    auc = F.when((F.col("positives") > 0) & (F.col("negatives") > 0), F.col("won") / (F.col("positives").cast("double") * F.col("negatives").cast("double")))
    return out.select(*keys, "positives", "negatives", auc.alias("auc"))


def _by_value(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    rows = df.select(*keys, F.col(label).alias("y"), F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double")).alias("score")).filter("y IS NOT NULL AND score IS NOT NULL")
    return rows.groupBy(*keys, "score").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))


def curve(df: DataFrame, keys: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """One row per keys and distinct score as threshold (score >= threshold): tp, fp, tpr, fpr, precision."""
    values = _by_value(df, keys, label, score)
    down = Window.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(*keys)
    c = values.select(*keys, F.col("score").alias("threshold"), F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"), F.sum("pos").over(everything).alias("p"), F.sum("neg").over(everything).alias("n"))
    return c.select(*keys, "threshold", "tp", "fp", _ratio(F.col("tp"), F.col("p"), None).alias("tpr"), _ratio(F.col("fp"), F.col("n"), None).alias("fpr"), _ratio(F.col("tp"), F.col("tp") + F.col("fp"), None).alias("precision"))


def average_precision(df: DataFrame, keys: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """Sum over distinct scores, from the highest, of the gain in recall times the precision."""
    c = curve(df, keys, label, score)
    before = F.coalesce(F.lag("tpr").over(Window.partitionBy(*keys).orderBy(F.desc("threshold"))), F.lit(0.0))
    return c.withColumn("part", (F.col("tpr") - before) * F.col("precision")).groupBy(*keys).agg(F.sum("part").alias("average_precision"))


def trapezoid_auc(df: DataFrame, keys: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC points by the trapezoid rule."""
    c = curve(df, keys, label, score)
    order = Window.partitionBy(*keys).orderBy(F.desc("threshold"))
    x0, y0 = (F.coalesce(F.lag(v).over(order), F.lit(0.0)) for v in ("fpr", "tpr"))
    return c.withColumn("part", (F.col("fpr") - x0) * (F.col("tpr") + y0) / 2).groupBy(*keys).agg(F.sum("part").alias("auc"))


def threshold_sweep(df: DataFrame, keys: list[str], steps: int = 100, label: str = "label", score: str = "score") -> DataFrame:
    """Counts and rates at the thresholds 0, 1/steps, ... 1 (score >= threshold) for scores from 0 to 1.

    One histogram pass and a running sum over its steps+1 bins, not a join with the thresholds.
    """
    s = F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))
    rows = df.select(*keys, F.col(label).alias("y"), s.alias("s")).filter("y IS NOT NULL AND s IS NOT NULL")
    step = F.lit(float(steps))
    k = F.floor(F.col("s") * step)
    # the bin is the greatest k with k/steps <= s, whatever the product was rounded to
    k = F.when((k + 1) / step <= F.col("s"), k + 1).when(k / step > F.col("s"), k - 1).otherwise(k)
    rows = rows.withColumn("_k", F.greatest(F.lit(-1), F.least(k, F.lit(steps))).cast("int"))
    bins = rows.groupBy(*keys, "_k").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    per = bins.groupBy(*keys).agg(F.collect_list(F.struct("_k", "pos", "neg")).alias("_bins"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    grid = per.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    at = lambda c: F.aggregate(F.filter("_bins", lambda b: b["_k"] >= F.col("_t")), F.lit(0).cast("bigint"), lambda acc, b: acc + b[c])
    out = grid.select(*keys, (F.col("_t") / step).alias("threshold"), at("pos").alias("tp"), at("neg").alias("fp"), "_p", "_n")
    return rates(out.select(*keys, "threshold", "tp", (F.col("_n") - F.col("fp")).alias("tn"), "fp", (F.col("_p") - F.col("tp")).alias("fn")), 0.0)


def optimal_thresholds(sweep: DataFrame, keys: list[str], least: float = 0.9) -> DataFrame:
    """Per keys: the thresholds of the best f1, mcc, balanced accuracy and Youden index (the least on ties), and the least ones that reach a precision and the greatest that keep a recall."""
    best = lambda c: F.max_by("threshold", F.struct(F.round(c, 9), -F.col("threshold")))
    youden = F.col("recall") + F.col("specificity") - 1
    return sweep.groupBy(*keys).agg(
        best(F.col("f1")).alias("best_f1"), best(F.col("mcc")).alias("best_mcc"), best(F.col("balanced_accuracy")).alias("best_balanced"), best(youden).alias("best_youden"),
        F.min(F.when(F.col("precision") >= least, F.col("threshold"))).alias("precise"), F.max(F.when(F.col("recall") >= least, F.col("threshold"))).alias("sensitive"),
    )


def over_runs(df: DataFrame, keys: list[str], run: str, metric: str) -> DataFrame:
    """mean, population and sample deviation (0 for one run), min, max, best run (the first on ties) and the list of runs."""
    m = F.col(metric)
    return df.groupBy(*keys).agg(
        F.count(m).alias("runs"), F.avg(m).alias("mean"), F.stddev_pop(m).alias("std_pop"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias("std"), F.min(m).alias("min"), F.max(m).alias("max"),
        F.min_by(run, F.struct(-m, F.col(run))).alias("best"), F.array_join(F.array_sort(F.collect_list(run)), ",").alias("seen"),
    )


def description(df: DataFrame, keys: list[str], value: str, above: float) -> DataFrame:
    """Count, mean, population deviation, extremes, percentiles (linear), share of zeros and share above a value."""
    v = F.col(value)
    at = F.percentile(v, F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.9, 0.95, 0.99))))
    out = df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), at.alias("q"), (100 * F.avg((v == 0).cast("double"))).alias("zeros"), (100 * F.avg((v > above).cast("double"))).alias("above"))
    return out.select(*keys, "n", "mean", "std", "min", "max", *(F.col("q")[i].alias(n) for i, n in enumerate(("p25", "p50", "p75", "p90", "p95", "p99"))), "zeros", "above")


def robust_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """median, iqr, max, snr (max over median, null at 0), mad (scaled by 1.4826) and the levels 3 and 5 mads above the median."""
    v = F.col(value)
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    first = df.groupBy(*keys).agg(F.count(v).alias("n"), q.alias("q"), F.max(v).alias("max")).select(*keys, "n", F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "max")
    mad = df.join(first.select(*keys, "median"), keys).groupBy(*keys).agg((F.percentile(F.abs(v - F.col("median")), 0.5) * 1.4826).alias("mad"))
    out = first.join(mad, keys)
    return out.withColumns({"snr": F.when(F.col("median") != 0, F.col("max") / F.col("median")), "level3": F.col("median") + 3 * F.col("mad"), "level5": F.col("median") + 5 * F.col("mad")})


def vote(df: DataFrame, keys: list[str], p0: str, p1: str) -> DataFrame:
    """Mean probabilities per keys and the greater one's class; class 0 on ties."""
    means = df.groupBy(*keys).agg(F.avg(p0).alias("mean_0"), F.avg(p1).alias("mean_1"), F.count("*").alias("votes"))
    return means.withColumn("voted", (F.col("mean_1") > F.col("mean_0")).cast("int"))


def logit_vote(df: DataFrame, keys: list[str], p0: str, p1: str) -> DataFrame:
    """Mean logits per keys, softmax and class."""
    z = df.groupBy(*keys).agg(F.avg(F.log(p0)).alias("z0"), F.avg(F.log(p1)).alias("z1"))
    soft = 1 / (1 + F.exp(F.col("z0") - F.col("z1")))
    return z.select(*keys, soft.alias("p1"), (F.col("z1") > F.col("z0")).cast("int").alias("voted"))


def cross_entropy(df: DataFrame, keys: list[str], label: str, p1: str, clip: float = 1e-7) -> DataFrame:
    """Mean binary cross entropy with clipped probabilities, and the perplexity."""
    p = F.greatest(F.lit(clip), F.least(F.col(p1), F.lit(1 - clip)))
    loss = -F.when(F.col(label) == 1, F.log(p)).when(F.col(label) == 0, F.log(1 - p))
    out = df.groupBy(*keys).agg(F.count(loss).alias("n"), F.avg(loss).alias("loss"))
    return out.withColumn("perplexity", F.exp("loss"))


def regression(df: DataFrame, keys: list[str], truth: str, guess: str) -> DataFrame:
    """mse, mae, r2 and Pearson's correlation."""
    y, p = F.col(truth).cast("double"), F.col(guess).cast("double")
    rows = df.filter(y.isNotNull() & p.isNotNull())
    out = rows.groupBy(*keys).agg(F.avg((y - p) * (y - p)).alias("mse"), F.avg(F.abs(y - p)).alias("mae"), F.var_pop(y).alias("_var"), F.corr(y, p).alias("pearson"))
    return out.withColumn("r2", F.when(F.col("_var") != 0, 1 - F.col("mse") / F.col("_var"))).drop("_var")


def multiclass(df: DataFrame, keys: list[str], truth: str, guess: str) -> DataFrame:
    """Accuracy, weighted and macro precision, recall and f1, and the multiclass mcc, from counts per pair of classes."""
    rows = df.filter(F.col(truth).isNotNull() & F.col(guess).isNotNull())
    pairs = rows.groupBy(*keys, F.col(truth).alias("_t"), F.col(guess).alias("_g")).agg(F.count("*").alias("c"))
    sides = pairs.select(*keys, F.col("_t").alias("_cls"), F.col("c").alias("support"), F.lit(0).cast("bigint").alias("called"), F.when(F.col("_t") == F.col("_g"), F.col("c")).otherwise(0).alias("hit"))
    sides = sides.unionByName(pairs.select(*keys, F.col("_g").alias("_cls"), F.lit(0).cast("bigint").alias("support"), F.col("c").alias("called"), F.lit(0).cast("bigint").alias("hit")))
    per = sides.groupBy(*keys, "_cls").agg(F.sum("support").cast("double").alias("support"), F.sum("called").cast("double").alias("called"), F.sum("hit").cast("double").alias("hit"))
    zero = lambda a, b: F.when(b != 0, a / b).otherwise(0.0)
    per = per.withColumns({"p": zero(F.col("hit"), F.col("called")), "r": zero(F.col("hit"), F.col("support")), "f": zero(2 * F.col("hit"), F.col("called") + F.col("support"))})
    w = F.sum("support")
    out = per.groupBy(*keys).agg(
        w.alias("n"), F.sum("hit").alias("c"), F.sum(F.col("called") * F.col("support")).alias("tp_"), F.sum(F.col("called") * F.col("called")).alias("pp"), F.sum(F.col("support") * F.col("support")).alias("tt"),
        *((F.sum(F.col(x) * F.col("support")) / w).alias(f"weighted_{n}") for x, n in (("p", "precision"), ("r", "recall"), ("f", "f1"))), *(F.avg(x).alias(f"macro_{n}") for x, n in (("p", "precision"), ("r", "recall"), ("f", "f1"))),
    )
    n, c = F.col("n"), F.col("c")
    den = F.sqrt((n * n - F.col("pp")) * (n * n - F.col("tt")))
    out = out.withColumns({"accuracy": c / n, "mcc": F.when(den > 0, (c * n - F.col("tp_")) / den).otherwise(0.0)})
    return out.select(*keys, "accuracy", *(f"{a}_{m}" for a in ("weighted", "macro") for m in ("precision", "recall", "f1")), "mcc")


def chi_square_terms(df: DataFrame, group: str, observed: str, expected: str, least: float = 5.0) -> DataFrame:
    """Goodness of fit: groups with an expected count below least are pooled as 'Other (pooled)'."""
    name = F.when(F.col(expected) < least, F.lit("Other (pooled)")).otherwise(F.col(group))
    pooled = df.groupBy(name.alias("group")).agg(F.sum(observed).cast("double").alias("observed"), F.sum(expected).alias("expected"))
    return pooled.withColumn("term", F.try_divide(F.pow(F.col("observed") - F.col("expected"), 2), F.col("expected")))


def chi_square_p(statistic: float, freedom: int) -> float:
    """Upper tail of the chi-square distribution, by the series or the continued fraction of the incomplete gamma function."""
    import math

    a, x = freedom / 2, statistic / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def one_vs_rest_auc(df: DataFrame, keys: list[str], truth: str, scores: dict[int, str]) -> DataFrame:
    """Areas under the ROC curve of each class against the rest, weighted by the classes' numbers: (keys, auc)."""
    parts = F.array(*(F.struct(F.lit(c).alias("_cls"), F.col(s).cast("double").alias("_s"), (F.col(truth) == c).cast("int").alias("_y")) for c, s in scores.items()))
    long = df.filter(F.col(truth).isNotNull()).select(*keys, F.explode(parts).alias("_x")).select(*keys, "_x.*")
    per = roc_auc(long, [*keys, "_cls"], "_y", "_s").filter("auc IS NOT NULL")
    return per.groupBy(*keys).agg((F.sum(F.col("auc") * F.col("positives")) / F.sum("positives")).alias("auc"))


def top_k_accuracy(df: DataFrame, keys: list[str], truth: str, scores: str, k: int) -> DataFrame:
    """Share of rows whose class is among the k greatest of an array of scores (the lesser class first on ties)."""
    ranked = F.array_sort(F.transform(F.col(scores), lambda s, i: F.struct((-s).alias("s"), i.alias("i"))))
    hit = F.array_contains(F.transform(F.slice(ranked, 1, k), lambda x: x["i"]), F.col(truth).cast("int"))
    rows = df.filter(F.col(truth).isNotNull() & F.col(scores).isNotNull())
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(hit.cast("double")).alias("accuracy"))


def multilabel_f1_max(df: DataFrame, keys: list[str], labels: str, scores: str) -> DataFrame:
    """The greatest pooled f1 over all thresholds, of arrays of labels (0 or 1) and scores: (keys, f1_max, threshold)."""
    zipped = F.explode(F.arrays_zip(F.col(labels).alias("y"), F.col(scores).alias("s")))
    long = df.select(*keys, zipped.alias("_x")).select(*keys, F.col("_x.y").cast("int").alias("_y"), F.col("_x.s").cast("double").alias("_s"))
    c = curve(long, keys, "_y", "_s")
    # tp / tpr is the number of positives
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("tp") / F.col("tpr"))).otherwise(0.0)
    return c.withColumn("f1", f1).groupBy(*keys).agg(F.max("f1").alias("f1_max"), F.max_by("threshold", F.struct("f1", "threshold")).alias("threshold"))


def histogram(df: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """(keys, bin, start, end, n): equal bins from low to high, values beyond in the outer ones; the data of a density plot."""
    v = F.col(value)
    width = (high - low) / bins
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((v - low) / F.lit(width)))).cast("int")
    return df.filter(v.isNotNull()).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n")).select(*keys, "bin", (F.lit(low) + F.col("bin") * width).alias("start"), (F.lit(low) + (F.col("bin") + 1) * width).alias("end"), "n")


def running_loss(df: DataFrame, keys: list[str], loss: str, tokens: str) -> DataFrame:
    """Token-weighted loss and perplexity of batches: sums that merge."""
    t = F.sum(tokens)
    out = df.groupBy(*keys).agg(t.alias("tokens"), F.try_divide(F.sum(F.col(loss) * F.col(tokens)), t).alias("loss"))
    return out.withColumn("perplexity", F.exp("loss"))


def cumulative_curve(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, rows, fraction): the share of rows with at least each distinct value, from the greatest down. Distinct values are ordered, not rows."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    down = Window.partitionBy(*keys).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.withColumns({"rows": F.sum("_n").over(down), "_all": F.sum("_n").over(Window.partitionBy(*keys))})
    return rows.select(*keys, value, "rows", (F.col("rows") / F.col("_all")).alias("fraction"))
