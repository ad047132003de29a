"""Queries on texts, events and embeddings: annotation categories, nested properties, models, sketches, streams, whole pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from windrow.functions import annotations as an
from windrow.functions.sequences import clean_bases
from windrow.operators import graph, learn
from windrow.plans import pipelines
from windrow.plans.evaluation import PRED, RATES, predictions, rounded
from windrow.plans.sequences import VAL, over_all, records
from windrow.streaming import live

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _events(spark, d):
    """The events as a stream, their times as instants."""
    return live.table_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _plain_times(df):
    """Times without zone, as in the tables."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


def _like(column: str, words) -> str:
    return " OR ".join(f"contains(lower({column}), '{w}')" for w in words)


_CATEGORY = "CASE WHEN text IS NULL OR text = '' THEN 'unknown' " + " ".join(f"WHEN {_like('text', ws)} THEN '{n}'" for n, ws in an.CATEGORIES) + " ELSE 'other' END"


@query(f"SELECT {_CATEGORY} AS category, count(*) AS texts, round(avg(n_chars), 6) AS mean_chars FROM documents GROUP BY 1")
def q_text_categories(spark, d):
    """Texts by the first category whose words they hold."""
    return rounded(read(spark, d, "documents").groupBy(an.category("text").alias("category")).agg(F.count("*").alias("texts"), F.avg("n_chars").alias("mean_chars")), 6)


@query(f"SELECT lower(trim(source)) AS source, count(*) AS texts, count(*) FILTER ({_like('text', an.PHAGE_KEYWORDS)}) AS related FROM documents GROUP BY 1")
def q_phage_texts(spark, d):
    """Texts per source with a phage keyword."""
    return read(spark, d, "documents").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.count("*").alias("texts"), F.count_if(an.contains_any("text")).alias("related"))


@query("""WITH p AS (SELECT unnest(string_split(coalesce(nullif(trim(p_brand), ''), '-'), '')) AS letter, p_size FROM part) SELECT letter, count(*) AS n, count(*) FILTER (p_size > 25) AS large, round(avg(p_size), 6) AS mean FROM p GROUP BY letter""")
def q_multivalue_category(spark, d):
    """A value counts for each letter of its category; repeated letters count again."""
    p = read(spark, d, "part").select(F.explode(an.cog_letters("p_brand")).alias("letter"), "p_size")
    return rounded(p.groupBy("letter").agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 25).alias("large"), F.avg("p_size").alias("mean")), 6)


@query(PRED + ", f AS (SELECT model, coalesce(genome, 'no_category') AS category, count(*) AS n, count(*) FILTER (pred = 0) AS fn, round(count(*) FILTER (pred = 0) / count(*), 9) AS fnr, round(avg(score), 9) AS mean_score FROM pred WHERE label = 1 GROUP BY ALL HAVING count(*) >= 3) SELECT * FROM f")
def q_fnr_by_category(spark, d):
    """Share of positives missed per category (here the genome) of at least three."""
    p = predictions(spark, d).filter("label = 1").groupBy("model", F.coalesce("genome", F.lit("no_category")).alias("category"))
    out = p.agg(F.count("*").alias("n"), F.count_if(F.col("pred") == 0).alias("fn"), F.avg("score").alias("mean_score")).filter("n >= 3")
    return rounded(out.withColumn("fnr", F.col("fn") / F.col("n")))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (json_valid(props)) AS valid, min(length(props)) AS least FROM events GROUP BY event_type")
def q_nested_properties(spark, d):
    """How many of the nested properties can be read."""
    e = read(spark, d, "events")
    parsed = F.get_json_object("props", "$").isNotNull()
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(parsed).alias("valid"), F.min(F.length("props")).cast("bigint").alias("least"))


@query("""WITH e AS (SELECT label, embedding FROM embeddings WHERE label IS NOT NULL), x AS (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS i FROM e) SELECT label, i AS position, round(avg(v), 5) AS mean, round(max(v), 5) AS peak FROM x GROUP BY ALL""")
def q_pooled_embeddings(spark, d):
    """Mean and greatest value of each place of the vectors of a label."""
    e = read(spark, d, "embeddings").filter("label IS NOT NULL").select("label", F.posexplode("embedding").alias("position", "v"))
    return rounded(e.groupBy("label", F.col("position").cast("bigint").alias("position")).agg(F.avg(F.col("v").cast("double")).alias("mean"), F.max(F.col("v").cast("double")).alias("peak")), 5)


@query("""WITH e AS (SELECT vec_id, list_max(embedding)::DOUBLE AS mx, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / len(embedding) AS mean, len(list_filter(embedding, lambda x: x > 0)) / len(embedding) AS share FROM embeddings)
 SELECT vec_id, round(mx, 5) AS max, round(mean, 5) AS mean, round(share, 5) AS share, mx > 0.5 OR mean > 0.1 OR share > 0.3 AS firing FROM e""")
def q_activation_summary(spark, d):
    s = read(spark, d, "embeddings").select("vec_id", an.activation_summary("embedding").alias("s"))
    return rounded(s.select("vec_id", "s.max", "s.mean", "s.share", an.firing("s").alias("firing")), 5)


@query()
def q_linear_probe(spark, d):
    """Labels 0 and 1 of the embeddings told apart by a logistic regression on the other half."""
    e = read(spark, d, "embeddings").filter("label IS NOT NULL").select("vec_id", F.col("embedding").alias("features"), (F.col("label") % 2).cast("double").alias("label"))
    return learn.linear_probe(e.filter("vec_id % 2 = 0"), e.filter("vec_id % 2 = 1"), "features", iterations=50).select("vec_id", "label", "prob_1", "pred")


@query()
def q_principal_components(spark, d):
    shares = learn.explained_variance(read(spark, d, "embeddings"), "embedding", 2)
    return spark.createDataFrame([(i + 1, v) for i, v in enumerate(shares)], "component int, explained double")


@query("""WITH q AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 100 = 0 AND label IS NOT NULL), p AS (SELECT q.vec_id, q.label, e.label AS other, sum(list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[])) AS total, count(*) AS n FROM q, embeddings e WHERE e.label IS NOT NULL GROUP BY ALL),
 s AS (SELECT vec_id, label, max(CASE WHEN other = label AND n > 1 THEN total / (n - 1) END) AS a, min(CASE WHEN other <> label THEN total / n END) AS b FROM p GROUP BY ALL) SELECT vec_id, label, round(a, 5) AS a, round(b, 5) AS b, round(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 5) + 0.0 AS silhouette FROM s""")
def q_silhouette(spark, d):
    return rounded(learn.silhouette(read(spark, d, "embeddings"), "vec_id", "embedding", "label"), 5)


_SKETCH = VAL.replace("WITH rec", "WITH RECURSIVE rec") + """, w AS (SELECT DISTINCT segment_id AS k, substr(md5(least(x, reverse(translate(x, 'ACGT', 'TGCA')))), 1, 16) AS h FROM (SELECT segment_id, unnest(list_transform(range(1, length(sequence) - 19), lambda i: substr(sequence, i, 21))) AS x FROM rec WHERE length(sequence) >= 21) WHERE regexp_full_match(x, '[ACGT]+')),
 sk AS (SELECT k, h FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY h) AS r FROM w) WHERE r <= 100), pr AS (SELECT DISTINCT a.k AS a, b.k AS b FROM sk a JOIN sk b ON a.h = b.h AND a.k < b.k),
 un AS (SELECT a, b, h, count(*) AS c FROM (SELECT a, b, h FROM pr JOIN sk ON sk.k = pr.a UNION ALL SELECT a, b, h FROM pr JOIN sk ON sk.k = pr.b) GROUP BY ALL), ur AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY h) AS r FROM un),
 j AS (SELECT a, b, count(*) FILTER (c = 2) / count(*) AS jaccard FROM ur WHERE r <= 100 GROUP BY a, b), dd AS (SELECT a, b, jaccard, greatest(0, -ln(2 * jaccard / (1 + jaccard)) / 21) AS distance FROM j WHERE jaccard > 0)"""


@query(_SKETCH + " SELECT a, b, round(jaccard, 9) AS jaccard, round(distance, 9) + 0.0 AS distance FROM dd WHERE distance <= 0.2")
def q_sketch_distances(spark, d, *names):
    """Pairs of records (of val, if no tables are named) by the distance of their hash sketches."""
    return rounded(learn.sketch_distances(records(spark, d, *names), "segment_id", "sequence"))


@query(_SKETCH + """, e AS (SELECT a AS u, b AS v FROM dd WHERE distance <= 0.05 UNION SELECT b, a FROM dd WHERE distance <= 0.05 UNION SELECT segment_id, segment_id FROM rec), r(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v), c AS (SELECT u AS node, min(v) AS component FROM r GROUP BY u),
 s AS (SELECT component, count(*) AS size FROM c GROUP BY component), n AS (SELECT *, row_number() OVER (ORDER BY size DESC, component) - 1 AS cluster FROM s) SELECT node, cluster, size FROM c JOIN n USING (component)""")
def q_sketch_clusters(spark, d, *names):
    """Single linkage at a distance of 0.05; records without a near one are clusters of their own."""
    r = records(spark, d, *names)
    near = learn.sketch_distances(r, "segment_id", "sequence", most=0.05)
    edges = near.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(r.select(F.col("segment_id").alias("src"), F.col("segment_id").alias("dst")))
    out = learn.numbered_clusters(graph.connected_components(edges))
    return out.select("node", F.col("cluster").cast("bigint").alias("cluster"), "size")


@query("""WITH w AS (SELECT event_type, value, unnest(range(0, 2)) AS k, ts FROM events), x AS (SELECT event_type, value, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') - k * INTERVAL '1 hour' AS start FROM w)
 SELECT start, start + INTERVAL '2 hours' AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM x GROUP BY ALL""")
def q_stream_windows(spark, d):
    """Sliding windows of event time over the events as a stream."""
    s = live.windowed(_events(spark, d), "ts", "2 hours", "1 hour", ["event_type"], "value")
    return _plain_times(rounded(live.run_available(s, "windows"), 4))


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
 SELECT min(ts) AS start, max(ts) + INTERVAL '6 hours' AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def q_stream_sessions(spark, d):
    """Sessions over the events as a stream; they are in no order, so none is too late."""
    s = live.sessions(_events(spark, d), "ts", "6 hours", ["user_id"], late=None)
    return _plain_times(live.run_available(s, "sessions"))


@query("WITH c AS (SELECT model, count(*) FILTER (label = 1 AND pred_label = 1) AS tp, count(*) FILTER (label = 0 AND pred_label = 0) AS tn, count(*) FILTER (label = 0 AND pred_label = 1) AS fp, count(*) FILTER (label = 1 AND pred_label = 0) AS fn FROM predictions GROUP BY model) SELECT *, " + RATES + " FROM c")
def q_stream_confusion(spark, d):
    """Counts that grow as files of predictions arrive (rows as delivered)."""
    p = live.table_stream(spark, d, "predictions").withColumnRenamed("pred_label", "pred")
    return rounded(live.run_available(live.running_confusion(p, ["model"]), "confusion"))


@query()
def q_genome_wide_pipeline(spark, d):
    """All segments, cut into windows, scored by the stand-in model and joined into regions."""
    s = read(spark, d, "segments").filter("segment_id IS NOT NULL").groupBy("segment_id").agg(F.max(clean_bases("sequence")).alias("sequence"))
    r = s.filter(F.length("sequence") > 0).select(F.col("segment_id").alias("assembly"), F.col("segment_id").alias("seq_id"), "sequence")
    return pipelines.genome_wide(r, "assembly", {"gc": pipelines.gc_scorer()}, 500, 250, threshold=0.55, gap=500, smallest=1000, step=250)


for _f in (q_sketch_distances, q_sketch_clusters):
    query()(over_all(_f))
