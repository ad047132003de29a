"""Queries along genomes: windows to bins, smoothing, regions, agreement with known prophages, grid search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from windrow.operators import intervals as iv
from windrow.operators import signal as sg
from windrow.operators.metrics import rates
from windrow.plans.evaluation import PRED, RATES, predictions, rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


K = ["model", "seq_id"]


def windows(spark, d):
    """Scored windows on a contig, one per model, contig and start."""
    rows = predictions(spark, d).filter("seq_id IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL AND start < end AND score IS NOT NULL")
    best = rows.groupBy("model", "seq_id", "start").agg(F.min_by(F.struct("segment_id", "end", "label", "score", "pred"), F.struct("end", "segment_id")).alias("r"))
    return best.select("model", "seq_id", "start", "r.*")


WIN = PRED + """, win AS (SELECT model, seq_id, segment_id, start, "end", label, score, pred FROM (SELECT *, row_number() OVER (PARTITION BY model, seq_id, start ORDER BY "end", segment_id) AS k FROM pred WHERE seq_id IS NOT NULL AND start IS NOT NULL AND "end" IS NOT NULL AND start < "end" AND score IS NOT NULL) WHERE k = 1)"""
BINS = WIN + """, span AS (SELECT model, seq_id, min(start) AS lo, max("end") AS hi FROM win GROUP BY ALL), wb AS (SELECT w.*, lo, hi, unnest(range(CAST(ceil((start - lo) / 1000.0) AS BIGINT), CASE WHEN "end" = hi THEN (hi - 1 - lo) // 1000 ELSE ("end" - lo) // 1000 - 1 END + 1)) AS k FROM win w JOIN span USING (model, seq_id)),
 bins AS (SELECT model, seq_id, lo + k * 1000 AS start, least(lo + k * 1000 + 1000, hi) AS "end", avg(score) AS score, CASE WHEN 2 * sum(pred) > count(pred) THEN 1 ELSE 0 END AS pred, arg_min(coalesce(label, -1), (start, "end", segment_id)) AS label_, count(*) AS windows FROM wb GROUP BY model, seq_id, lo, hi, k)"""


@query(BINS + 'SELECT model, seq_id, start, "end", round(score, 9) AS score, pred, nullif(label_, -1) AS label, windows FROM bins')
def q_collapse_windows(spark, d):
    return rounded(sg.collapse(windows(spark, d), K))


def _regions_sql(before: str, last: str) -> str:
    return WIN + f""", pos AS (SELECT *, {before} AS b FROM win WHERE pred = 1 WINDOW w AS (PARTITION BY model, seq_id ORDER BY start, "end")),
 isl AS (SELECT *, sum(CASE WHEN b IS NULL OR start - b > 3000 THEN 1 ELSE 0 END) OVER (PARTITION BY model, seq_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS i FROM pos),
 reg AS (SELECT model, seq_id, min(start) AS start, {last} AS "end", count(*) AS windows, avg(score) AS avg_score FROM isl GROUP BY model, seq_id, i)
 SELECT model, seq_id, start, "end", "end" - start AS size, windows, round(avg_score, 9) AS avg_score FROM reg WHERE "end" - start >= 1000"""


@query(_regions_sql('max("end") OVER (PARTITION BY model, seq_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)', 'max("end")'))
def q_regions_running(spark, d):
    return rounded(sg.regions(windows(spark, d).filter("pred = 1"), K, 3000, 1000))


@query(_regions_sql('lag("end") OVER w', 'arg_max("end", (start, "end"))'))
def q_regions_previous(spark, d):
    return rounded(sg.regions(windows(spark, d).filter("pred = 1"), K, 3000, 1000, running=False))


@query(WIN + """, n AS (SELECT *, row_number() OVER (PARTITION BY model, seq_id ORDER BY start) AS n FROM win), r AS (SELECT *, n - row_number() OVER (PARTITION BY model, seq_id ORDER BY start) AS run FROM n WHERE pred = 1)
 SELECT model, seq_id, min(start) AS first, max(start) AS last, count(*) AS rows FROM r GROUP BY model, seq_id, run""")
def q_true_runs(spark, d):
    return sg.true_runs(windows(spark, d), K, "start", "pred")


@query(WIN + """, g AS (SELECT *, lag(start) OVER (PARTITION BY model, seq_id ORDER BY start) AS b FROM win WHERE score > 0.3), i AS (SELECT *, sum(CASE WHEN b IS NULL OR start - b > 20000 THEN 1 ELSE 0 END) OVER (PARTITION BY model, seq_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS i FROM g)
 SELECT model, seq_id, min(start) AS first, max(start) AS last, max(start) - min(start) AS size, count(*) AS positions FROM i GROUP BY model, seq_id, i HAVING count(*) >= 2""")
def q_position_clusters(spark, d):
    return sg.position_clusters(windows(spark, d).filter("score > 0.3"), K, "start", 20_000, 2)


@query(WIN + """SELECT model, seq_id, start, round(sum(score) OVER f, 9) AS rolling_sum, round(avg(score) OVER f, 9) AS rolling_mean, round(quantile_cont(score, 0.5) OVER f, 9) AS rolling_median FROM win WINDOW f AS (PARTITION BY model, seq_id ORDER BY start ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def q_rolling(spark, d):
    return rounded(sg.rolling(windows(spark, d).select("model", "seq_id", "start", "score"), K, "start", "score", 5).drop("score"))


@query(WIN + """, n AS (SELECT *, row_number() OVER (PARTITION BY model, seq_id ORDER BY start) AS n FROM win), f AS (SELECT a.model, a.seq_id, a.start, b.score, quantile_cont(b.score, 0.5) OVER (PARTITION BY a.model, a.seq_id, a.start) AS med FROM n a JOIN n b ON a.model = b.model AND a.seq_id = b.seq_id AND b.n BETWEEN a.n - 2 AND a.n + 2)
 SELECT model, seq_id, start, round(any_value(med), 9) AS rolling_median, round(quantile_cont(abs(score - med), 0.5), 9) AS rolling_mad FROM f GROUP BY model, seq_id, start""")
def q_rolling_mad(spark, d):
    return rounded(sg.rolling_mad(windows(spark, d).select("model", "seq_id", "start", "score"), K, "start", "score", 5).drop("score"))


@query(WIN + """, a AS (SELECT model, seq_id, start, avg(score) OVER f AS average, count(*) OVER f AS n, row_number() OVER (PARTITION BY model, seq_id ORDER BY start) - 1 AS i FROM win WINDOW f AS (PARTITION BY model, seq_id ORDER BY start ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
 SELECT model, seq_id, start, round(average, 9) AS average FROM a WHERE n = 4 AND i % 2 = 0""")
def q_moving_average(spark, d):
    return rounded(sg.moving_average(windows(spark, d), K, "start", "score", 4, 2))


@query(WIN.replace("WITH raw", "WITH RECURSIVE raw", 1) + """, n AS (SELECT model, seq_id, start, score, row_number() OVER (PARTITION BY model, seq_id ORDER BY start) AS i, row_number() OVER (PARTITION BY model, seq_id ORDER BY start DESC) AS j FROM win),
 f AS (SELECT model, seq_id, i, score AS v FROM n WHERE i = 1 UNION ALL SELECT n.model, n.seq_id, n.i, f.v + (n.score - f.v) / 3 FROM f JOIN n ON n.model = f.model AND n.seq_id = f.seq_id AND n.i = f.i + 1),
 b AS (SELECT model, seq_id, j, score AS v FROM n WHERE j = 1 UNION ALL SELECT n.model, n.seq_id, n.j, b.v + (n.score - b.v) / 3 FROM b JOIN n ON n.model = b.model AND n.seq_id = b.seq_id AND n.j = b.j + 1)
 SELECT n.model, n.seq_id, n.start, round((f.v + b.v) / 2, 9) AS smooth FROM n JOIN f ON f.model = n.model AND f.seq_id = n.seq_id AND f.i = n.i JOIN b ON b.model = n.model AND b.seq_id = n.seq_id AND b.j = n.j""")
def q_ewm_smooth(spark, d):
    return rounded(sg.smooth(windows(spark, d).select("model", "seq_id", "start", "score"), K, "start", "score", 5).drop("score"))


_Q = ", q AS (SELECT model, seq_id, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS q2, quantile_cont(score, 0.75) AS q3, avg(score) AS mean, stddev_pop(score) AS sd, min(score) AS lo, max(score) AS hi, count(*) AS n FROM win GROUP BY ALL), md AS (SELECT w.model, w.seq_id, quantile_cont(abs(score - q2), 0.5) AS mad FROM win w JOIN q USING (model, seq_id) GROUP BY ALL)"
_NORMAL = {
    "zscore": "CASE WHEN sd > 1e-12 THEN (score - mean) / sd ELSE 0 END", "robust": "CASE WHEN mad > 0 THEN (score - q2) / mad ELSE score - q2 END", "median": "score - q2",
    "minmax": "CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0 END", "iqr": "CASE WHEN q3 - q1 > 0 THEN (score - q2) / (q3 - q1) ELSE score - q2 END",
    "rank": "(rank() OVER (PARTITION BY w.model, w.seq_id ORDER BY score) + (count(*) OVER (PARTITION BY w.model, w.seq_id, score) - 1) / 2.0) / n",
}


def _normalized(method):
    def f(spark, d):
        rows = windows(spark, d).select("model", "seq_id", "start", "score")
        return rounded(sg.normalize(rows, K, "score", method).drop("score"), 9 if method == "median" else 6)

    return f


for _m, _e in _NORMAL.items():
    QUERIES[f"q_normalize_{_m}"] = _normalized(_m)
    SQL[f"q_normalize_{_m}"] = WIN + _Q + f" SELECT w.model, w.seq_id, start, round({_e}, {9 if _m == 'median' else 6}) + 0.0 AS normal FROM win w JOIN q USING (model, seq_id) JOIN md USING (model, seq_id)"


@query(WIN + _Q + " SELECT q.model, q.seq_id, round(q2 + 3 * 1.4826 * mad, 9) AS by_mad, round(mean + 3 * sd, 9) AS by_deviation, (SELECT round(quantile_cont(score, 0.95), 9) FROM win x WHERE x.model = q.model AND x.seq_id = q.seq_id) AS by_percentile FROM q JOIN md USING (model, seq_id)")
def q_adaptive_thresholds(spark, d):
    return rounded(sg.adaptive_thresholds(windows(spark, d), K, "score"))


@query(WIN + """, x AS (SELECT model, seq_id, score, unnest(range(start // 500, ("end" - 1) // 500 + 1)) AS bin FROM win) SELECT model, seq_id, bin, round(max(score), 9) AS peak FROM x GROUP BY ALL""")
def q_max_track(spark, d):
    return rounded(sg.max_track(windows(spark, d), K, 500))


@query(WIN + """, x AS (SELECT model, seq_id, score, unnest(range(start // 500, ("end" - 1) // 500 + 1)) AS bin FROM win), t AS (SELECT model, seq_id, bin, max(score) AS peak FROM x GROUP BY ALL) SELECT model, seq_id, bin // 20 AS bin, round(max(peak), 9) AS peak FROM t GROUP BY model, seq_id, bin // 20""")
def q_downsampled_track(spark, d):
    t = sg.max_track(windows(spark, d), K, 500)
    return rounded(t.groupBy("model", "seq_id", F.floor(F.col("bin") / 20).alias("bin")).agg(F.max("peak").alias("peak")))


@query(WIN + "SELECT model, seq_id, start, CASE WHEN start >= 49000 AND start % 49000 < 1000 THEN 0.0 ELSE round(score, 9) END AS score FROM win")
def q_window_edges_masked(spark, d):
    rows = windows(spark, d)
    return rounded(rows.select("model", "seq_id", "start", F.when(sg.mask_window_edges(F.col("start"), edge=1000), 0.0).otherwise(F.col("score")).alias("score")))


_UNIT = "CASE WHEN max({c}) OVER p > min({c}) OVER p THEN ({c} - min({c}) OVER p) / (max({c}) OVER p - min({c}) OVER p) ELSE 0 END"


@query(WIN + ", g AS (SELECT model, seq_id, max(score) AS mx, avg(score) AS mean, avg(CASE WHEN score > 0.5 THEN 1.0 ELSE 0.0 END) AS frac FROM win GROUP BY ALL), u AS (SELECT model, seq_id, " + ", ".join(f"{_UNIT.format(c=c)} AS {n}" for c, n in (("mx", "a"), ("mean", "b"), ("frac", "c"))) + " FROM g WINDOW p AS (PARTITION BY model)) SELECT model, seq_id, "
       + ", ".join(f"round({ws[0]!r} * a + {ws[1]!r} * b + {ws[2]!r} * c, 6) AS {n}" for n, ws in sg.COMBINATIONS.items()) + " FROM u")
def q_combined_scores(spark, d):
    g = windows(spark, d).groupBy(*K).agg(F.max("score").alias("mx"), F.avg("score").alias("mean"), F.avg((F.col("score") > 0.5).cast("double")).alias("frac"))
    return rounded(sg.combined_scores(g, ["model"], ("mx", "mean", "frac")).select(*K, *sg.COMBINATIONS), 6)


_GRID = BINS + """, th AS (SELECT unnest([0.3, 0.5, 0.7]::DOUBLE[]) AS threshold), ga AS (SELECT unnest([0, 3000, 10000]) AS gap), si AS (SELECT unnest([0, 2000, 5000]) AS smallest),
 pos AS (SELECT b.*, threshold, gap, lag("end") OVER (PARTITION BY model, seq_id, threshold, gap ORDER BY start, "end") AS b FROM bins b, th, ga WHERE score >= threshold),
 isl AS (SELECT *, sum(CASE WHEN b IS NULL OR start - b > gap THEN 1 ELSE 0 END) OVER (PARTITION BY model, seq_id, threshold, gap ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS i FROM pos),
 reg AS (SELECT model, seq_id, threshold, gap, max("end") - min(start) AS size, count(*) FILTER (label_ = 1) AS tp, count(*) FILTER (label_ = 0) AS fp FROM isl GROUP BY model, seq_id, threshold, gap, i),
 kept AS (SELECT model, seq_id, threshold, gap, smallest, sum(tp) AS tp, sum(fp) AS fp FROM reg, si WHERE size >= smallest GROUP BY ALL),
 tot AS (SELECT model, seq_id, count(*) FILTER (label_ = 1) AS p, count(*) FILTER (label_ = 0) AS n FROM bins GROUP BY ALL),
 c AS (SELECT model, seq_id, threshold, gap, smallest, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(n - coalesce(fp, 0) AS BIGINT) AS tn, CAST(coalesce(fp, 0) AS BIGINT) AS fp, CAST(p - coalesce(tp, 0) AS BIGINT) AS fn FROM (SELECT * FROM tot, th, ga, si) LEFT JOIN kept USING (model, seq_id, threshold, gap, smallest)),
 r AS (SELECT *, """ + RATES + """ FROM c), s AS (SELECT model, threshold, gap, smallest, count(*) AS genomes, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(avg(mcc), 6) + 0.0 AS macro_mcc, round(avg(coalesce(precision, 0)), 6) AS macro_precision, round(avg(coalesce(recall, 0)), 6) AS macro_recall, round(avg(coalesce(f1, 0)), 6) AS macro_f1 FROM r GROUP BY ALL),
 f AS (SELECT *, """ + RATES + """ FROM s), g AS (SELECT model, threshold, gap, smallest, genomes, tp, tn, fp, fn, macro_mcc, macro_precision, macro_recall, macro_f1, round(mcc, 6) AS micro_mcc FROM f)"""


def _grid(spark, d):
    bins = sg.collapse(windows(spark, d), K)
    return rounded(sg.grid_search(bins, ["model"], "seq_id", [0.3, 0.5, 0.7], [0, 3000, 10_000], [0, 2000, 5000]), 6)


@query(_GRID + " SELECT * FROM g")
def q_grid_search(spark, d):
    return _grid(spark, d)


@query(_GRID + ", k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY macro_mcc DESC, threshold, gap, smallest) AS k FROM g) SELECT * EXCLUDE (k) FROM k WHERE k = 1")
def q_grid_search_best(spark, d):
    return sg.best_per_key(_grid(spark, d), ["model"], "macro_mcc", ["threshold", "gap", "smallest"])


_SIGNALS = BINS.replace("WITH raw", "WITH RECURSIVE raw", 1) + """, q AS (SELECT model, seq_id, quantile_cont(score, 0.5) AS q2, avg(score) AS mean, stddev_pop(score) AS sd FROM bins GROUP BY ALL), md AS (SELECT b.model, b.seq_id, quantile_cont(abs(score - q2), 0.5) AS mad FROM bins b JOIN q USING (model, seq_id) GROUP BY ALL),
 nrm AS (SELECT model, seq_id, start, "end", label_, method, CASE method WHEN 'none' THEN score WHEN 'zscore' THEN CASE WHEN sd > 1e-12 THEN (score - mean) / sd ELSE 0 END WHEN 'robust' THEN CASE WHEN mad > 0 THEN (score - q2) / mad ELSE score - q2 END ELSE score - q2 END AS v
  FROM bins JOIN q USING (model, seq_id) JOIN md USING (model, seq_id), (SELECT unnest(['none', 'zscore', 'robust', 'median']) AS method)),
 n AS (SELECT *, row_number() OVER (PARTITION BY model, seq_id, method ORDER BY start) AS i, row_number() OVER (PARTITION BY model, seq_id, method ORDER BY start DESC) AS j FROM nrm),
 fw AS (SELECT model, seq_id, method, i, v FROM n WHERE i = 1 UNION ALL SELECT n.model, n.seq_id, n.method, n.i, fw.v + (n.v - fw.v) / 3 FROM fw JOIN n ON n.model = fw.model AND n.seq_id = fw.seq_id AND n.method = fw.method AND n.i = fw.i + 1),
 bw AS (SELECT model, seq_id, method, j, v FROM n WHERE j = 1 UNION ALL SELECT n.model, n.seq_id, n.method, n.j, bw.v + (n.v - bw.v) / 3 FROM bw JOIN n ON n.model = bw.model AND n.seq_id = bw.seq_id AND n.method = bw.method AND n.j = bw.j + 1),
 sig AS (SELECT model, seq_id, method, start, "end", label_, 1 AS span, round(v, 6) AS score FROM n
  UNION ALL SELECT n.model, n.seq_id, n.method, n.start, n."end", n.label_, 5, round((fw.v + bw.v) / 2, 6) FROM n JOIN fw ON fw.model = n.model AND fw.seq_id = n.seq_id AND fw.method = n.method AND fw.i = n.i JOIN bw ON bw.model = n.model AND bw.seq_id = n.seq_id AND bw.method = n.method AND bw.j = n.j),
 cells AS (SELECT * REPLACE (model || '|' || method || '|' || span AS model) FROM sig)""" + _GRID[len(BINS) :].replace("FROM bins", "FROM cells").replace("round(mcc, 6) AS micro_mcc", "mcc AS micro_mcc")


@query(_SIGNALS + " SELECT split_part(model, '|', 1) AS model, split_part(model, '|', 2) AS method, CAST(split_part(model, '|', 3) AS INT) AS span, * EXCLUDE (model) FROM g")
def q_grid_search_signals(spark, d):
    """The grid over normalisations and smoothings of the bins as well."""
    bins = sg.collapse(windows(spark, d), K)
    g = sg.grid_search_signals(bins, ["model"], "seq_id", ["none", "zscore", "robust", "median"], [1, 5], [0.3, 0.5, 0.7], [0, 3000, 10_000], [0, 2000, 5000], digits=6)
    return rounded(g.withColumn("micro_mcc", F.round("micro_mcc", 9).cast("decimal(20,9)")), 6).withColumn("micro_mcc", F.col("micro_mcc").cast("double") + F.lit(0.0))


def truth(spark, d):
    """Known prophages per contig, in order."""
    k = spark.read.parquet(f"{d}/known_prophages.parquet")
    s, e = F.least("start", "end"), F.greatest("start", "end")
    named = k.filter("start IS NOT NULL AND end IS NOT NULL AND start <> end").select(iv.contig_name("ncbi_id").alias("seq_id"), s.alias("start"), e.alias("end"))
    return named.filter("seq_id IS NOT NULL").distinct()


TRUTH = """, tru AS (SELECT DISTINCT upper(regexp_replace(ncbi_id, '^\\s+|\\s+$', '', 'g')) AS seq_id, least(start, "end") AS start, greatest(start, "end") AS "end" FROM known_prophages WHERE start <> "end" AND trim(ncbi_id) <> '')"""


@query(WIN + TRUTH + """SELECT w.model, w.seq_id, w.start AS l_start, w."end" AS l_end, t.start AS r_start, t."end" AS r_end, least(w."end", t."end") - greatest(w.start, t.start) AS overlap FROM win w JOIN tru t ON w.seq_id = t.seq_id AND least(w."end", t."end") - greatest(w.start, t.start) >= 50 WHERE w.pred = 1""")
def q_overlap_join(spark, d):
    called = windows(spark, d).filter("pred = 1").select("seq_id", "model", "start", "end")
    j = iv.overlap_join(called, truth(spark, d), ["seq_id"], least=50)
    return j.select(F.col("l_model").alias("model"), "seq_id", "l_start", "l_end", "r_start", "r_end", "overlap")


_MERGED = """{name}m AS (SELECT model, seq_id, start, "end", max("end") OVER (PARTITION BY model, seq_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM {name}),
 {name}i AS (SELECT *, sum(CASE WHEN b IS NULL OR start > b THEN 1 ELSE 0 END) OVER (PARTITION BY model, seq_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS i FROM {name}m), {name}u AS (SELECT model, seq_id, min(start) AS start, max("end") AS "end" FROM {name}i GROUP BY model, seq_id, i)"""


@query(WIN + TRUTH + """, len AS (SELECT model, seq_id, max("end") AS length FROM win GROUP BY ALL), tt AS (SELECT model, seq_id, greatest(0, t.start) AS start, least(t."end", length) AS "end" FROM len JOIN tru t USING (seq_id) WHERE greatest(0, t.start) < least(t."end", length)),
 cc AS (SELECT model, seq_id, greatest(0, start) AS start, "end" FROM win WHERE pred = 1), """ + _MERGED.format(name="tt") + ", " + _MERGED.format(name="cc") + """,
 ov AS (SELECT t.model, t.seq_id, sum(least(t."end", c."end") - greatest(t.start, c.start)) AS tp FROM ttu t JOIN ccu c ON t.model = c.model AND t.seq_id = c.seq_id AND t.start < c."end" AND c.start < t."end" GROUP BY ALL),
 ts AS (SELECT model, seq_id, sum("end" - start) AS t FROM ttu GROUP BY ALL), cs AS (SELECT model, seq_id, sum("end" - start) AS c FROM ccu GROUP BY ALL),
 al AS (SELECT model, seq_id, length, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(coalesce(c, 0) - coalesce(tp, 0) AS BIGINT) AS fp, CAST(coalesce(t, 0) - coalesce(tp, 0) AS BIGINT) AS fn FROM len LEFT JOIN ts USING (model, seq_id) LEFT JOIN cs USING (model, seq_id) LEFT JOIN ov USING (model, seq_id)),
 x AS (SELECT model, seq_id, tp, CAST(length - tp - fp - fn AS BIGINT) AS tn, fp, fn FROM al) SELECT *, """ + RATES + " FROM x")
def q_base_confusion(spark, d):
    """Agreement in bases of the called windows with the known prophages of the same contig."""
    w = windows(spark, d)
    lengths = w.groupBy(*K).agg(F.max("end").alias("length"))
    known = lengths.select(*K).join(truth(spark, d), "seq_id")
    return rounded(rates(iv.base_confusion(known, w.filter("pred = 1").select(*K, "start", "end"), lengths, K)))


@query(WIN + TRUTH + """SELECT w.model, t.seq_id, t.start, t."end", count(*) AS windows, round(avg(score), 9) AS mean, round(max(score), 9) AS max, round(avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END), 9) AS firing FROM tru t JOIN win w ON w.seq_id = t.seq_id AND w.start >= t.start AND w.start < t."end" GROUP BY ALL""")
def q_region_stats(spark, d):
    """The windows that begin inside each known prophage: number, mean and greatest score, share above one half."""
    points = windows(spark, d).select("seq_id", "model", "score", "start", (F.col("start") + 1).alias("end"))
    j = iv.overlap_join(points, truth(spark, d), ["seq_id"])
    return rounded(j.groupBy(F.col("l_model").alias("model"), "seq_id", F.col("r_start").alias("start"), F.col("r_end").alias("end")).agg(
        F.count("*").alias("windows"), F.avg("l_score").alias("mean"), F.max("l_score").alias("max"), F.avg((F.col("l_score") >= 0.5).cast("double")).alias("firing")))


@query("WITH x AS (SELECT 1)" + TRUTH + """SELECT seq_id, count(*) AS regions, round(avg("end" - start), 9) AS mean_size, CAST(sum("end" - start) AS BIGINT) AS total, min("end" - start) AS least, max("end" - start) AS greatest FROM tru GROUP BY seq_id""")
def q_known_region_stats(spark, d):
    size = F.col("end") - F.col("start")
    return rounded(truth(spark, d).groupBy("seq_id").agg(F.count("*").alias("regions"), F.avg(size).alias("mean_size"), F.sum(size).alias("total"), F.min(size).alias("least"), F.max(size).alias("greatest")))


_FLAG = WIN + """, pos AS (SELECT *, max("end") OVER (PARTITION BY model, seq_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM win WHERE pred = 1),
 isl AS (SELECT *, sum(CASE WHEN b IS NULL OR start - b > 3000 THEN 1 ELSE 0 END) OVER (PARTITION BY model, seq_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS i FROM pos),
 sz AS (SELECT model, seq_id, i, max("end") - min(start) AS size FROM isl GROUP BY model, seq_id, i), keep AS (SELECT model, seq_id, start FROM isl JOIN sz USING (model, seq_id, i) WHERE size >= 3000),
 both_ AS (SELECT w.model, w.seq_id, w.label, 'raw' AS kind, w.pred FROM win w UNION ALL SELECT w.model, w.seq_id, w.label, 'filtered', CASE WHEN k.start IS NOT NULL THEN 1 ELSE 0 END FROM win w LEFT JOIN keep k ON k.model = w.model AND k.seq_id = w.seq_id AND k.start = w.start),
 c AS (SELECT model, kind, seq_id, count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 0) AS tn, count(*) FILTER (label = 0 AND pred = 1) AS fp, count(*) FILTER (label = 1 AND pred = 0) AS fn FROM both_ GROUP BY ALL), r AS (SELECT *, """ + RATES + """ FROM c),
 m AS (SELECT model, kind, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM c GROUP BY ALL), mm AS (SELECT *, """ + RATES + """ FROM m)
 SELECT model, kind, 'aggregate' AS over, tp, tn, fp, fn, round(mcc, 6) AS mcc, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM mm
 UNION ALL SELECT model, kind, 'average', CAST(sum(tp) AS BIGINT), CAST(sum(tn) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT), round(avg(mcc), 6) + 0.0, round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6) FROM r GROUP BY model, kind"""


@query(_FLAG)
def q_genome_wide_summary(spark, d):
    """The flagship: windows to regions, small regions dropped, raw and filtered metrics pooled and averaged over contigs."""
    w = windows(spark, d)
    order = Window.partitionBy(*K).orderBy("start", "end")
    pos = w.filter("pred = 1").withColumn("_new", (F.col("start") - F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)) > 3000).cast("int"))
    pos = pos.withColumn("_i", F.sum(F.coalesce("_new", F.lit(1))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.max("end").over(Window.partitionBy(*K, "_i")) - F.min("start").over(Window.partitionBy(*K, "_i"))
    pos = pos.withColumn("_keep", (size >= 3000).cast("int")).select(*K, "start", "_keep")
    both = w.join(pos, [*K, "start"], "left").withColumn("_x", F.explode(F.array(F.struct(F.lit("raw").alias("kind"), F.col("pred").alias("p")), F.struct(F.lit("filtered").alias("kind"), F.coalesce("_keep", F.lit(0)).alias("p")))))
    both = both.select(*K, "label", "_x.kind", F.col("_x.p").alias("pred"))
    from windrow.operators.metrics import COUNTS, confusion

    per = both.groupBy("model", "kind", "seq_id").agg(*confusion())
    four = ("mcc", "precision", "recall", "f1")
    pooled = rates(per.groupBy("model", "kind").agg(*(F.sum(c).alias(c) for c in COUNTS))).select("model", "kind", F.lit("aggregate").alias("over"), *COUNTS, *four)
    mean = rates(per).groupBy("model", "kind").agg(*(F.sum(c).alias(c) for c in COUNTS), *(F.avg(c).alias(c) for c in four)).select("model", "kind", F.lit("average").alias("over"), *COUNTS, *four)
    return rounded(pooled.unionByName(mean), 6)
