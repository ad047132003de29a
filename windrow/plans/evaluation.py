"""Queries over predictions: confusion, micro and macro metrics, curves, sweeps, votes, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windrow.operators import metrics as m, sampling as sm
from windrow.operators.predictions import genome_of, mismatches, normalize_predictions


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Canonical predictions with the genome of each segment."""
    rows = normalize_predictions(spark.read.parquet(f"{d}/predictions.parquet"))
    return rows.withColumn("genome", genome_of("segment_id"))


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, with -0 as 0."""
    return df.select(*((F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


PRED = """
WITH raw AS (SELECT model, segment_id, nullif(upper(trim(seq_id)), '') AS seq_id, CAST(label AS INT) AS label, start, "end", CASE WHEN isnan(prob_1) THEN NULL ELSE prob_1 END AS score, CAST(pred_label AS INT) AS pred_label, loaded_at
             FROM predictions WHERE segment_id IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY model, segment_id ORDER BY loaded_at DESC NULLS LAST, label DESC NULLS LAST, start DESC NULLS LAST, "end" DESC NULLS LAST, score DESC NULLS LAST, pred_label DESC NULLS LAST, seq_id DESC NULLS LAST) AS rn FROM raw),
pred AS (SELECT model, segment_id, seq_id, label, start, "end", score, coalesce(pred_label, CASE WHEN score IS NULL THEN NULL WHEN score >= 0.5 THEN 1 ELSE 0 END) AS pred,
                nullif(regexp_extract(segment_id, '(GC[AF]_[0-9]+\\.[0-9]+)', 1), '') AS genome FROM ranked WHERE rn = 1)
"""
COUNTS = """count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 0) AS tn, count(*) FILTER (label = 0 AND pred = 1) AS fp, count(*) FILTER (label = 1 AND pred = 0) AS fn"""


def _sql_rates(undefined: str = "NULL") -> str:
    def ratio(a: str, b: str) -> str:
        return f"CASE WHEN ({b}) <> 0 THEN CAST(({a}) AS DOUBLE) / ({b}) ELSE {undefined} END"

    den = "(CAST(tp AS DOUBLE) + fp) * (CAST(tp AS DOUBLE) + fn) * (CAST(tn AS DOUBLE) + fp) * (CAST(tn AS DOUBLE) + fn)"
    parts = {
        "accuracy": ratio("tp + tn", "tp + tn + fp + fn"), "precision": ratio("tp", "tp + fp"), "recall": ratio("tp", "tp + fn"), "specificity": ratio("tn", "tn + fp"), "f1": ratio("2 * tp", "2 * tp + fp + fn"),
        "fpr": ratio("fp", "fp + tn"), "fnr": ratio("fn", "fn + tp"), "balanced_accuracy": f"(({ratio('tp', 'tp + fn')}) + ({ratio('tn', 'tn + fp')})) / 2",
        "mcc": f"CASE WHEN {den} > 0 THEN (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / sqrt({den}) ELSE 0 END", "jaccard": ratio("tp", "tp + fp + fn"),
    }
    return ", ".join(f"round({v}, 9) + 0.0 AS {k}" for k, v in parts.items())


RATES, RATES0 = _sql_rates(), _sql_rates("0")
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(PRED + 'SELECT model, segment_id, seq_id, label, start, "end", round(score, 9) AS score, pred, genome FROM pred')
def q_predictions(spark, d):
    return rounded(predictions(spark, d))


@query(PRED + "SELECT model, count(*) AS rows, count(*) FILTER (pred <> CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AND score IS NOT NULL) AS mismatches, count(*) FILTER (score IS NULL) AS unscored FROM pred GROUP BY model")
def q_label_mismatches(spark, d):
    return mismatches(predictions(spark, d))


@query(PRED + f", c AS (SELECT model, genome, count(*) FILTER (label IS NOT NULL AND pred IS NOT NULL) AS n, {COUNTS} FROM pred GROUP BY model, genome) SELECT *, {RATES} FROM c")
def q_confusion_by_genome(spark, d):
    return rounded(m.confusion_by(predictions(spark, d), ["model", "genome"]))


_MACRO = PRED + f", c AS (SELECT model, genome, {COUNTS} FROM pred GROUP BY model, genome), r AS (SELECT *, {RATES.replace('round(', 'identity_(').replace(', 9) + 0.0 AS', ') AS')} FROM c)"
_MACRO = _MACRO.replace("identity_(", "(")


def _micro_macro_sql(mean) -> str:
    macro = ", ".join(f"round({mean(c)}, 9) + 0.0 AS macro_{c}" for c in m.MEANS)
    return _MACRO + f""", s AS (SELECT model, count(*) AS units, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, {macro} FROM r GROUP BY model),
    f AS (SELECT *, {RATES} FROM s) SELECT model, units, tp, tn, fp, fn, accuracy AS micro_accuracy, mcc AS micro_mcc, precision AS micro_precision, recall AS micro_recall, f1 AS micro_f1, macro_mcc, macro_precision, macro_recall, macro_f1 FROM f"""


@query(_micro_macro_sql(lambda c: f"avg({c})"))
def q_micro_macro(spark, d):
    return rounded(m.micro_macro(predictions(spark, d), ["model"], "genome"))


@query(_micro_macro_sql(lambda c: f"avg(coalesce({c}, 0))"))
def q_micro_macro_zero(spark, d):
    return rounded(m.micro_macro(predictions(spark, d), ["model"], "genome", skip_undefined=False))


@query(PRED + f", k AS (SELECT * FROM pred WHERE label IS NOT NULL AND pred IS NOT NULL), c AS (SELECT model, coalesce(genome, 'none') AS genome, count(*) AS n, {COUNTS} FROM k GROUP BY model, coalesce(genome, 'none') UNION ALL SELECT model, 'AGGREGATE', count(*), {COUNTS} FROM k GROUP BY model) SELECT *, {RATES0} FROM c")
def q_metrics_summary(spark, d):
    """Per genome after leaving out rows without label or prediction, and one aggregate row per model."""
    rows = predictions(spark, d).na.drop(subset=["label", "pred"]).withColumn("genome", F.coalesce("genome", F.lit("none")))
    both = rows.withColumn("genome", F.explode(F.array("genome", F.lit("AGGREGATE"))))
    return rounded(m.rates(both.groupBy("model", "genome").agg(F.count("*").alias("n"), *m.confusion()), 0.0))


_VALUES = PRED + ", v AS (SELECT model, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM pred WHERE label IS NOT NULL AND score IS NOT NULL GROUP BY model, score)"


@query(_VALUES + """, w AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM v),
 s AS (SELECT model, CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives, sum(CAST(pos AS DOUBLE) * (below + neg / 2.0)) AS won FROM w GROUP BY model)
 SELECT model, positives, negatives, round(CASE WHEN positives > 0 AND negatives > 0 THEN won / (CAST(positives AS DOUBLE) * negatives) END, 9) AS auc FROM s""")
def q_auc(spark, d):
    return rounded(m.roc_auc(predictions(spark, d), ["model"]))


_CURVE = _VALUES + """, c AS (SELECT model, score AS threshold, sum(pos) OVER o AS tp, sum(neg) OVER o AS fp, sum(pos) OVER (PARTITION BY model) AS p, sum(neg) OVER (PARTITION BY model) AS n FROM v WINDOW o AS (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
 r AS (SELECT model, threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tp AS DOUBLE) / nullif(p, 0) AS tpr, CAST(fp AS DOUBLE) / nullif(n, 0) AS fpr, CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS precision FROM c)"""


@query(_CURVE + " SELECT model, round(threshold, 9) AS threshold, tp, fp, round(tpr, 9) AS tpr, round(fpr, 9) AS fpr, round(precision, 9) AS precision FROM r")
def q_roc_points(spark, d):
    return rounded(m.curve(predictions(spark, d), ["model"]))


@query(_CURVE + ", g AS (SELECT model, (tpr - coalesce(lag(tpr) OVER (PARTITION BY model ORDER BY threshold DESC), 0)) * precision AS part FROM r) SELECT model, round(sum(part), 9) AS average_precision FROM g GROUP BY model")
def q_average_precision(spark, d):
    return rounded(m.average_precision(predictions(spark, d), ["model"]))


@query(_CURVE + ", g AS (SELECT model, (fpr - coalesce(lag(fpr) OVER o, 0)) * (tpr + coalesce(lag(tpr) OVER o, 0)) / 2 AS part FROM r WINDOW o AS (PARTITION BY model ORDER BY threshold DESC)) SELECT model, round(sum(part), 9) AS auc FROM g GROUP BY model")
def q_trapezoid_auc(spark, d):
    return rounded(m.trapezoid_auc(predictions(spark, d), ["model"]))


_SWEEP = PRED + f""", t AS (SELECT i / 100.0::DOUBLE AS threshold FROM range(0, 101) x(i)), k AS (SELECT model, threshold, label, CASE WHEN score >= threshold THEN 1 ELSE 0 END AS pred FROM pred, t WHERE label IS NOT NULL AND score IS NOT NULL),
 c AS (SELECT model, threshold, {COUNTS} FROM k GROUP BY model, threshold), s AS (SELECT *, {RATES0} FROM c)"""


@query(_SWEEP + " SELECT * REPLACE (round(threshold, 9) AS threshold) FROM s")
def q_threshold_sweep(spark, d):
    return rounded(m.threshold_sweep(predictions(spark, d), ["model"]))


@query(_SWEEP + """, b AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold) AS a1, row_number() OVER (PARTITION BY model ORDER BY mcc DESC, threshold) AS a2,
   row_number() OVER (PARTITION BY model ORDER BY balanced_accuracy DESC, threshold) AS a3, row_number() OVER (PARTITION BY model ORDER BY round(recall + specificity - 1, 9) DESC, threshold) AS a4 FROM s)
 SELECT model, max(CASE WHEN a1 = 1 THEN threshold END) AS best_f1, max(CASE WHEN a2 = 1 THEN threshold END) AS best_mcc, max(CASE WHEN a3 = 1 THEN threshold END) AS best_balanced, max(CASE WHEN a4 = 1 THEN threshold END) AS best_youden,
  min(CASE WHEN precision >= 0.9 THEN threshold END) AS precise, max(CASE WHEN recall >= 0.9 THEN threshold END) AS sensitive FROM b GROUP BY model""")
def q_optimal_thresholds(spark, d):
    return rounded(m.optimal_thresholds(rounded(m.threshold_sweep(predictions(spark, d), ["model"])), ["model"]))


_GENOMES = PRED + f", c AS (SELECT model, genome, {COUNTS} FROM pred WHERE genome IS NOT NULL GROUP BY model, genome), r AS (SELECT *, {RATES} FROM c)"


def _genomes(spark, d):
    return rounded(m.confusion_by(predictions(spark, d).filter("genome IS NOT NULL"), ["model", "genome"]).drop("n"))


@query(_GENOMES + """, b AS (SELECT model, genome, mcc, row_number() OVER (PARTITION BY model ORDER BY mcc DESC, genome) AS k FROM r)
 SELECT model, count(mcc) AS runs, round(avg(mcc), 9) AS mean, round(stddev_pop(mcc), 9) AS std_pop, round(coalesce(stddev_samp(mcc), 0), 9) AS std, min(mcc) AS min, max(mcc) AS max, max(CASE WHEN k = 1 THEN genome END) AS best, string_agg(genome, ',' ORDER BY genome) AS seen FROM b GROUP BY model""")
def q_over_genomes(spark, d):
    return rounded(m.over_runs(_genomes(spark, d), ["model"], "genome", "mcc"))


@query(_GENOMES + """, u AS (UNPIVOT (SELECT model, genome, accuracy, precision, recall, f1, mcc FROM r) ON accuracy, precision, recall, f1, mcc INTO NAME metric VALUE v)
 SELECT model, metric, round(avg(v), 9) AS average, round(stddev_samp(v), 9) AS std, min(v) AS min, max(v) AS max FROM u GROUP BY model, metric""")
def q_genome_table(spark, d):
    """Mean, sample deviation and extremes over genomes for each metric."""
    long = _genomes(spark, d).unpivot(["model", "genome"], ["accuracy", "precision", "recall", "f1", "mcc"], "metric", "v").filter("v IS NOT NULL")
    return rounded(long.groupBy("model", "metric").agg(F.avg("v").alias("average"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max")))


@query(_GENOMES + """, k AS (SELECT model, genome, CASE WHEN recall >= 0.7 THEN 'high' WHEN recall >= 0.3 THEN 'medium' ELSE 'low' END AS category FROM r WHERE recall IS NOT NULL) SELECT model, category, count(*) AS genomes FROM k GROUP BY model, category""")
def q_genome_categories(spark, d):
    """Genomes in bands of the first metric that any genome has: recall, mcc, f1, precision."""
    g = _genomes(spark, d)
    everything = Window.partitionBy("model")
    has = lambda c: F.max(F.col(c).isNotNull()).over(everything)
    v = F.when(has("recall"), F.col("recall")).when(has("mcc"), F.col("mcc")).when(has("f1"), F.col("f1")).otherwise(F.col("precision"))
    named = g.withColumn("v", v).filter("v IS NOT NULL").withColumn("category", F.when(F.col("v") >= 0.7, "high").when(F.col("v") >= 0.3, "medium").otherwise("low"))
    return named.groupBy("model", "category").agg(F.count("*").alias("genomes"))


_BANDS = "CASE WHEN score < 0.1 THEN '<0.1' WHEN score < 0.3 THEN '0.1-0.3' WHEN score < 0.5 THEN '0.3-0.5' WHEN score < 0.7 THEN '0.5-0.7' WHEN score < 0.9 THEN '0.7-0.9' ELSE '>=0.9' END"


@query(PRED + f"SELECT model, {_BANDS} AS band, count(*) AS rows, count(*) FILTER (label = 1) AS positives FROM pred WHERE score IS NOT NULL GROUP BY ALL")
def q_score_bands(spark, d):
    return predictions(spark, d).filter("score IS NOT NULL").groupBy("model", F.expr(_BANDS).alias("band")).agg(F.count("*").alias("rows"), F.count_if(F.col("label") == 1).alias("positives"))


@query(PRED + """SELECT model, count(score) AS n, round(avg(score), 9) AS mean, round(stddev_pop(score), 9) AS std, round(min(score), 9) AS min, round(max(score), 9) AS max, round(quantile_cont(score, 0.25), 9) AS p25, round(quantile_cont(score, 0.5), 9) AS p50, round(quantile_cont(score, 0.75), 9) AS p75,
 round(quantile_cont(score, 0.9), 9) AS p90, round(quantile_cont(score, 0.95), 9) AS p95, round(quantile_cont(score, 0.99), 9) AS p99, round(100 * avg(CASE WHEN score = 0 THEN 1.0 WHEN score IS NOT NULL THEN 0.0 END), 9) AS zeros, round(100 * avg(CASE WHEN score > 0.5 THEN 1.0 WHEN score IS NOT NULL THEN 0.0 END), 9) AS above FROM pred GROUP BY model""")
def q_describe(spark, d):
    return rounded(m.description(predictions(spark, d), ["model"], "score", 0.5))


@query(PRED + """, a AS (SELECT model, genome, count(score) AS n, quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.75) - quantile_cont(score, 0.25) AS iqr, max(score) AS mx FROM pred WHERE score IS NOT NULL AND genome IS NOT NULL GROUP BY model, genome),
 b AS (SELECT p.model, p.genome, quantile_cont(abs(score - median), 0.5) * 1.4826 AS mad FROM pred p JOIN a USING (model, genome) WHERE score IS NOT NULL GROUP BY p.model, p.genome)
 SELECT model, genome, n, round(median, 9) AS median, round(iqr, 9) AS iqr, round(mx, 9) AS max, round(mad, 9) + 0.0 AS mad, round(CASE WHEN median <> 0 THEN mx / median END, 9) AS snr, round(median + 3 * mad, 9) AS level3, round(median + 5 * mad, 9) AS level5 FROM a JOIN b USING (model, genome)""")
def q_genome_signal_stats(spark, d):
    return rounded(m.robust_stats(predictions(spark, d).filter("score IS NOT NULL AND genome IS NOT NULL"), ["model", "genome"], "score"))


@query(PRED + ", v AS (SELECT segment_id, avg(1 - score) AS a, avg(score) AS b, count(*) AS votes FROM pred WHERE score IS NOT NULL GROUP BY segment_id) SELECT segment_id, round(a, 9) AS mean_0, round(b, 9) AS mean_1, votes, CASE WHEN round(b, 9) > round(a, 9) THEN 1 ELSE 0 END AS voted FROM v")
def q_weighted_vote(spark, d):
    rows = predictions(spark, d).filter("score IS NOT NULL").withColumn("p0", 1 - F.col("score"))
    v = m.vote(rows, ["segment_id"], "p0", "score").withColumn("voted", (F.round("mean_1", 9) > F.round("mean_0", 9)).cast("int"))
    return rounded(v)


@query(PRED + ", c AS (SELECT segment_id, greatest(1e-7, least(score, 1 - 1e-7)) AS p FROM pred WHERE score IS NOT NULL), z AS (SELECT segment_id, avg(ln(1 - p)) AS z0, avg(ln(p)) AS z1 FROM c GROUP BY segment_id) SELECT segment_id, round(1 / (1 + exp(z0 - z1)), 9) AS p1 FROM z")
def q_logit_vote(spark, d):
    p = F.greatest(F.lit(1e-7), F.least("score", F.lit(1 - 1e-7)))
    rows = predictions(spark, d).filter("score IS NOT NULL").withColumn("p1", p).withColumn("p0", 1 - F.col("p1"))
    return rounded(m.logit_vote(rows, ["segment_id"], "p0", "p1").drop("voted"))


@query(PRED + ", c AS (SELECT model, label, greatest(1e-7, least(score, 1 - 1e-7)) AS p FROM pred WHERE score IS NOT NULL), l AS (SELECT model, CASE WHEN label = 1 THEN -ln(p) WHEN label = 0 THEN -ln(1 - p) END AS loss FROM c) SELECT model, count(loss) AS n, round(avg(loss), 9) AS loss, round(exp(avg(loss)), 9) AS perplexity FROM l GROUP BY model")
def q_cross_entropy(spark, d):
    return rounded(m.cross_entropy(predictions(spark, d).filter("score IS NOT NULL"), ["model"], "label", "score"))


@query(PRED + "SELECT model, round(avg((label - score) * (label - score)), 9) AS mse, round(avg(abs(label - score)), 9) AS mae, round(corr(label, score), 9) AS pearson, round(1 - avg((label - score) * (label - score)) / var_pop(label), 9) AS r2 FROM pred WHERE label IS NOT NULL AND score IS NOT NULL GROUP BY model")
def q_regression_metrics(spark, d):
    return rounded(m.regression(predictions(spark, d), ["model"], "label", "score"))


@query(PRED + """, b AS (SELECT model, segment_id, CAST(least(3, floor(4 * score)) AS INT) AS band FROM pred WHERE score IS NOT NULL), j AS (SELECT y.model, x.band AS t, y.band AS g FROM b x JOIN b y USING (segment_id) WHERE x.model = 'kmer_long' AND y.model <> 'kmer_long'),
 pr AS (SELECT model, t, g, count(*)::DOUBLE AS c FROM j GROUP BY ALL), cls AS (SELECT model, t AS k, sum(c) AS support, 0.0 AS called, sum(CASE WHEN t = g THEN c ELSE 0 END) AS hit FROM pr GROUP BY model, t UNION ALL SELECT model, g, 0, sum(c), 0 FROM pr GROUP BY model, g),
 per AS (SELECT model, k, sum(support) AS support, sum(called) AS called, sum(hit) AS hit FROM cls GROUP BY model, k),
 f AS (SELECT *, CASE WHEN called <> 0 THEN hit / called ELSE 0 END AS p, CASE WHEN support <> 0 THEN hit / support ELSE 0 END AS r, CASE WHEN called + support <> 0 THEN 2 * hit / (called + support) ELSE 0 END AS f FROM per),
 s AS (SELECT model, sum(support) AS n, sum(hit) AS c, sum(called * support) AS tp, sum(called * called) AS pp, sum(support * support) AS tt, sum(p * support) / sum(support) AS wp, sum(r * support) / sum(support) AS wr, sum(f * support) / sum(support) AS wf, avg(p) AS mp, avg(r) AS mr, avg(f) AS mf FROM f GROUP BY model)
 SELECT model, round(c / n, 9) AS accuracy, round(wp, 9) AS weighted_precision, round(wr, 9) AS weighted_recall, round(wf, 9) AS weighted_f1, round(mp, 9) AS macro_precision, round(mr, 9) AS macro_recall, round(mf, 9) AS macro_f1,
  round(CASE WHEN (n * n - pp) * (n * n - tt) > 0 THEN (c * n - tp) / sqrt((n * n - pp) * (n * n - tt)) ELSE 0 END, 9) AS mcc FROM s""")
def q_multiclass_agreement(spark, d):
    """Score bands of one model as classes, against those of the others."""
    b = predictions(spark, d).filter("score IS NOT NULL").select("model", "segment_id", F.least(F.lit(3), F.floor(4 * F.col("score"))).cast("int").alias("band"))
    truth = b.filter("model = 'kmer_long'").select("segment_id", F.col("band").alias("t"))
    return rounded(m.multiclass(b.filter("model <> 'kmer_long'").join(truth, "segment_id"), ["model"], "t", "band"))


@query(_GENOMES + """, s AS (SELECT model, round(avg(f1), 9) AS f1, round(avg(mcc), 9) AS mcc, round(avg(fpr), 9) AS fpr, round(avg(fnr), 9) AS fnr FROM r GROUP BY model)
 SELECT 'f1' AS metric, (SELECT model FROM s ORDER BY f1 DESC, model LIMIT 1) AS best, (SELECT max(f1) FROM s) AS value, (SELECT round(max(f1) - min(f1), 9) FROM s) AS spread
 UNION ALL SELECT 'mcc', (SELECT model FROM s ORDER BY mcc DESC, model LIMIT 1), (SELECT max(mcc) FROM s), (SELECT round(max(mcc) - min(mcc), 9) FROM s)
 UNION ALL SELECT 'fpr', (SELECT model FROM s ORDER BY fpr, model LIMIT 1), (SELECT min(fpr) FROM s), (SELECT round(max(fpr) - min(fpr), 9) FROM s)
 UNION ALL SELECT 'fnr', (SELECT model FROM s ORDER BY fnr, model LIMIT 1), (SELECT min(fnr) FROM s), (SELECT round(max(fnr) - min(fnr), 9) FROM s)""")
def q_best_model(spark, d):
    """The best model per metric; false-positive and false-negative rates are minimised."""
    s = rounded(_genomes(spark, d).groupBy("model").agg(*(F.avg(c).alias(c) for c in ("f1", "mcc", "fpr", "fnr"))))
    long = s.unpivot("model", ["f1", "mcc", "fpr", "fnr"], "metric", "v").withColumn("good", F.when(F.col("metric").isin("fpr", "fnr"), -F.col("v")).otherwise(F.col("v")))
    best = F.min_by(F.struct("model", "v"), F.struct(-F.col("good"), F.col("model")))
    out = long.groupBy("metric").agg(best.alias("b"), (F.max("v") - F.min("v")).alias("spread"))
    return rounded(out.select("metric", F.col("b.model").alias("best"), F.col("b.v").alias("value"), "spread"))


@query(_GENOMES + """, t AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, tp DESC, genome) AS place FROM r WHERE f1 IS NOT NULL) SELECT model, place, genome, f1, tp FROM t WHERE place <= 3""")
def q_top_genomes(spark, d):
    order = Window.partitionBy("model").orderBy(F.desc("f1"), F.desc("tp"), "genome")
    t = _genomes(spark, d).filter("f1 IS NOT NULL").withColumn("place", F.row_number().over(order))
    return t.filter("place <= 3").select("model", "place", "genome", "f1", "tp")


@query(_GENOMES + """, t AS (SELECT genome, round(stddev_samp(f1), 9) AS std, CAST(sum(tp + tn + fp + fn) AS BIGINT) AS samples FROM r GROUP BY genome) SELECT * FROM t WHERE std IS NOT NULL ORDER BY std DESC, genome LIMIT 10""")
def q_most_variable_genomes(spark, d):
    t = rounded(_genomes(spark, d).groupBy("genome").agg(F.stddev_samp("f1").alias("std"), F.sum(F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("samples")))
    return t.filter("std IS NOT NULL").orderBy(F.desc("std"), "genome").limit(10)


#: The models of the test tables, which the SQL twin of q_pivot_f1 must list; the query takes all there are.
_MODELS = ("kmer_long", "tiny_nn", "prok_small", "bidir_ssm", "gc_probe")


@query(_GENOMES + ", p AS (SELECT genome, " + ", ".join(f"round(avg(CASE WHEN model = '{x}' THEN f1 END), 9) AS {x}" for x in _MODELS) + " FROM r GROUP BY genome) SELECT * FROM p")
def q_pivot_f1(spark, d):
    """Mean f1 per genome with a column for every model of the table."""
    models = sorted(r["model"] for r in predictions(spark, d).select("model").filter("model IS NOT NULL").distinct().collect())
    return rounded(_genomes(spark, d).groupBy("genome").pivot("model", models).agg(F.avg("f1")))


@query(_GENOMES + " SELECT model, round(corr(f1, mcc), 9) AS f1_mcc, round(corr(precision, recall), 9) AS precision_recall, round(corr(recall, mcc), 9) AS recall_mcc FROM r WHERE f1 IS NOT NULL AND precision IS NOT NULL AND recall IS NOT NULL GROUP BY model")
def q_metric_correlations(spark, d):
    g = _genomes(spark, d).na.drop(subset=["f1", "precision", "recall"])
    return rounded(g.groupBy("model").agg(F.corr("f1", "mcc").alias("f1_mcc"), F.corr("precision", "recall").alias("precision_recall"), F.corr("recall", "mcc").alias("recall_mcc")))


@query(PRED + ", f AS (SELECT model, coalesce(genome, 'none') AS genome, count(*) AS fp FROM pred WHERE label = 0 AND pred = 1 GROUP BY ALL) SELECT model, genome, fp, round(CAST(sum(fp) OVER (PARTITION BY model ORDER BY fp DESC, genome ROWS UNBOUNDED PRECEDING) AS DOUBLE) / sum(fp) OVER (PARTITION BY model), 9) AS cumulative FROM f")
def q_cumulative_fp(spark, d):
    f = predictions(spark, d).filter("label = 0 AND pred = 1").groupBy("model", F.coalesce("genome", F.lit("none")).alias("genome")).agg(F.count("*").alias("fp"))
    running = Window.partitionBy("model").orderBy(F.desc("fp"), "genome").rowsBetween(Window.unboundedPreceding, 0)
    return rounded(f.withColumn("cumulative", F.sum("fp").over(running) / F.sum("fp").over(Window.partitionBy("model"))))


@query(PRED + """, t AS (SELECT label, coalesce(lower(trim(source)), 'none') AS source, count(DISTINCT segment_id) AS n FROM train WHERE label IS NOT NULL AND segment_id IS NOT NULL GROUP BY ALL),
 s AS (SELECT source, CAST(sum(n) AS DOUBLE) AS total, sum(CASE WHEN label = 1 THEN n ELSE 0 END) AS ones FROM t GROUP BY source), e AS (SELECT source, ones AS observed, total * (SELECT sum(ones) FROM s) / (SELECT sum(total) FROM s) AS expected FROM s),
 g AS (SELECT CASE WHEN expected < 5 THEN 'Other (pooled)' ELSE source END AS "group", CAST(sum(observed) AS DOUBLE) AS observed, sum(expected) AS expected FROM e GROUP BY 1) SELECT "group", observed, round(expected, 9) AS expected, round((observed - expected) ** 2 / expected, 9) AS term FROM g""")
def q_chi_square(spark, d):
    """Whether positives are spread over the sources as all records are."""
    t = spark.read.parquet(f"{d}/train.parquet").filter("label IS NOT NULL AND segment_id IS NOT NULL").select("segment_id", "label", F.coalesce(F.lower(F.trim("source")), F.lit("none")).alias("source")).distinct()
    s = t.groupBy("source").agg(F.count("*").cast("double").alias("total"), F.count_if(F.col("label") == 1).alias("observed"))
    sums = s.agg(F.sum("observed").alias("o"), F.sum("total").alias("t")).first()
    e = s.withColumn("expected", F.col("total") * F.lit(float(sums["o"] or 0)) / F.lit(float(sums["t"] or 1)))
    return rounded(m.chi_square_terms(e, "source", "observed", "expected"))


@query(PRED + ", c AS (SELECT model, round(score, 3) AS identity, count(*) AS n FROM pred WHERE score IS NOT NULL GROUP BY ALL) SELECT model, identity, CAST(sum(n) OVER d AS BIGINT) AS rows, round(sum(n) OVER d / sum(n) OVER (PARTITION BY model), 9) AS fraction FROM c WINDOW d AS (PARTITION BY model ORDER BY identity DESC ROWS UNBOUNDED PRECEDING)")
def q_cumulative_identity(spark, d):
    """Share of rows that reach each score, per model."""
    p = predictions(spark, d).filter("score IS NOT NULL").select("model", F.round("score", 3).alias("identity"))
    return rounded(m.cumulative_curve(p, ["model"], "identity"))


@query("WITH k AS (SELECT DISTINCT segment_id FROM train WHERE segment_id IS NOT NULL) SELECT segment_id, CAST((row_number() OVER (ORDER BY md5(segment_id || '|7'), segment_id) - 1) % 5 AS INT) AS fold, CASE WHEN (row_number() OVER (ORDER BY md5(segment_id || '|7'), segment_id) - 1) % 5 = 0 THEN 'validation' ELSE 'train' END AS split FROM k")
def q_equal_folds(spark, d):
    """Five shuffled folds of equal size, the first for validation."""
    return sm.fold_splits(sm.equal_folds(spark.read.parquet(f"{d}/train.parquet"), "segment_id", 5, 7), 0)
