"""Queries that build and audit data sets: selection, decontamination, allocation, splits, joins, documents, clusters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from windrow.functions import annotations as an
from windrow.operators import graph, sampling as sm, selection as sel
from windrow.operators.intervals import accession_number, contig_name
from windrow.operators.predictions import genome_of
from windrow.plans.evaluation import PRED, predictions, rounded
from windrow.plans.genome import TRUTH, truth

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


def meta(spark, d):
    """Segments' metadata, one row per segment, accessions without prefixes."""
    t = read(spark, d, "segment_metadata").filter("segment_id IS NOT NULL").withColumn("accession", an.bare_accession("accession"))
    best = F.max(F.struct("accession", "segment_num", "start", "end", "genome_length", "n_samples_from_genome"))
    return t.groupBy("segment_id").agg(best.alias("r")).select("segment_id", "r.*")


META = """WITH mr AS (SELECT segment_id, regexp_replace(accession, '^(GB|RS)_', '') AS accession, segment_num, start, "end", genome_length, n_samples_from_genome FROM segment_metadata WHERE segment_id IS NOT NULL),
meta AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY accession DESC NULLS LAST, segment_num DESC NULLS LAST, start DESC NULLS LAST, "end" DESC NULLS LAST, genome_length DESC NULLS LAST, n_samples_from_genome DESC NULLS LAST) AS k FROM mr) WHERE k = 1)"""
GENOMES = META + ", gen AS (SELECT accession, max(genome_length) AS genome_length, count(*) AS segments FROM meta WHERE accession IS NOT NULL GROUP BY accession)"


def genomes(spark, d):
    return meta(spark, d).filter("accession IS NOT NULL").groupBy("accession").agg(F.max("genome_length").alias("genome_length"), F.count("*").alias("segments"))


@query(META + ' SELECT * FROM meta')
def q_segment_metadata(spark, d):
    return meta(spark, d)


@query(META + ", tr AS (SELECT DISTINCT segment_id FROM train WHERE segment_id IS NOT NULL), x AS (SELECT t.segment_id AS a, m.segment_id AS b FROM tr t FULL JOIN meta m ON t.segment_id = m.segment_id) SELECT count(*) FILTER (b IS NULL) AS only_left, count(*) FILTER (a IS NULL) AS only_right, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS both FROM x")
def q_labels_metadata_audit(spark, d):
    return sel.missing_both_ways(read(spark, d, "train"), meta(spark, d), "segment_id")


@query(META + ", tr AS (SELECT segment_id, max(label) AS label FROM train WHERE segment_id IS NOT NULL GROUP BY segment_id) SELECT t.segment_id, label, accession, start FROM tr t LEFT JOIN meta USING (segment_id)")
def q_train_with_metadata(spark, d):
    t = read(spark, d, "train").filter("segment_id IS NOT NULL").groupBy("segment_id").agg(F.max("label").alias("label"))
    return t.join(meta(spark, d).select("segment_id", "accession", "start"), "segment_id", "left")


_HITS = ", hit AS (SELECT DISTINCT seq_id AS contig_id FROM pred WHERE pred = 1 AND score >= 0.7 AND seq_id IS NOT NULL), cm AS (SELECT DISTINCT upper(trim(contig_id)) AS contig_id, regexp_replace(genome_accession, '^(GB|RS)_', '') AS accession FROM contig_map WHERE contig_id IS NOT NULL)"


def _hits(spark, d):
    p = predictions(spark, d).filter("pred = 1 AND score >= 0.7 AND seq_id IS NOT NULL")
    m = read(spark, d, "contig_map").filter("contig_id IS NOT NULL").select(F.upper(F.trim("contig_id")).alias("contig_id"), "genome_accession")
    return sel.hit_genomes(p.select(F.col("seq_id").alias("sseqid")), m)


@query(PRED + _HITS + " SELECT DISTINCT accession FROM hit JOIN cm USING (contig_id)")
def q_contaminated_genomes(spark, d):
    """Genomes with a strongly called contig."""
    return _hits(spark, d)[0]


@query(PRED + _HITS + " SELECT contig_id FROM hit WHERE contig_id NOT IN (SELECT contig_id FROM cm)")
def q_unmapped_contigs(spark, d):
    return _hits(spark, d)[1]


@query(PRED + _HITS + GENOMES.replace("WITH mr", ", mr", 1) + " SELECT accession, genome_length, segments FROM gen WHERE accession NOT IN (SELECT accession FROM hit JOIN cm USING (contig_id) WHERE accession IS NOT NULL)")
def q_clean_genomes(spark, d):
    return sel.clean_genomes(genomes(spark, d), _hits(spark, d)[0].filter("accession IS NOT NULL"))


@query(PRED + TRUTH + ", kg AS (SELECT DISTINCT regexp_extract(assembly, '(GC[AF]_[0-9]+\\.[0-9]+)', 1) AS genome FROM known_prophages WHERE assembly IS NOT NULL) SELECT model, count(*) AS rows FROM pred WHERE genome IN (SELECT genome FROM kg) GROUP BY model")
def q_predictions_of_known_genomes(spark, d):
    kg = read(spark, d, "known_prophages").select(genome_of("assembly").alias("genome")).filter("genome IS NOT NULL").distinct()
    return predictions(spark, d).join(kg, "genome", "left_semi").groupBy("model").agg(F.count("*").alias("rows"))


@query(PRED + ", h AS (SELECT segment_id AS q, model AS s, round(100 * score, 6) AS pident, pred FROM pred WHERE score IS NOT NULL), b AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY pident DESC, s) AS k FROM h) SELECT q AS qseqid, s AS sseqid, pident FROM b WHERE k = 1")
def q_best_hit(spark, d):
    """The model with the greatest score of each segment, as best hits."""
    h = predictions(spark, d).filter("score IS NOT NULL").select(F.col("segment_id").alias("qseqid"), F.col("model").alias("sseqid"), F.round(100 * F.col("score"), 6).alias("pident"))
    return sel.best_hits(h.withColumn("bitscore", F.col("pident"))).select("qseqid", "sseqid", "pident")


@query(PRED + ", h AS (SELECT segment_id, max(100 * score) AS pident, 100.0 * least(1, max(\"end\" - start) / 2000.0) AS qcovs FROM pred WHERE score IS NOT NULL GROUP BY segment_id) " + " UNION ALL ".join(f"SELECT {t}.0::DOUBLE AS threshold, count(*) FILTER (pident >= {t} AND qcovs >= 50) AS leaked, count(*) AS queries, round(count(*) FILTER (pident >= {t} AND qcovs >= 50) / count(*), 9) AS share FROM h" for t in (50, 70, 80, 90, 95)))
def q_leak_thresholds(spark, d):
    h = predictions(spark, d).filter("score IS NOT NULL").groupBy("segment_id").agg(F.max(100 * F.col("score")).alias("pident"), (100.0 * F.least(F.lit(1.0), F.max(F.col("end") - F.col("start")) / F.lit(2000.0))).alias("qcovs"))
    return rounded(sel.leak_counts(h))


@query(PRED + TRUTH + ', a AS (SELECT DISTINCT genome, seq_id FROM pred WHERE genome IS NOT NULL), ga AS (SELECT regexp_extract(assembly, \'(GC[AF]_[0-9]+\\.[0-9]+)\', 1) AS genome, min(organism_name) AS o FROM known_prophages GROUP BY 1), gc AS (SELECT upper(trim(ncbi_id)) AS seq_id, min(organism_name) AS o FROM known_prophages WHERE ncbi_id IS NOT NULL GROUP BY 1) SELECT a.genome, a.seq_id, coalesce(ga.o, gc.o) AS organism_name FROM a LEFT JOIN ga USING (genome) LEFT JOIN gc USING (seq_id)')
def q_organism_with_fallback(spark, d):
    """Each contig's organism by its assembly or else by the contig's own name."""
    a = predictions(spark, d).filter("genome IS NOT NULL").select("genome", "seq_id").distinct()
    k = read(spark, d, "known_prophages").select(genome_of("assembly").alias("ga"), contig_name("ncbi_id").alias("sc"), "organism_name")
    return sel.fallback_join(a, k, [("genome", "ga"), ("seq_id", "sc")], "organism_name")


@query(GENOMES + ", x AS (SELECT *, substr(accession, 5, 4) AS clade FROM gen), r AS (SELECT *, row_number() OVER (PARTITION BY clade ORDER BY md5(accession || '|3'), accession) AS k FROM x) SELECT clade, accession, genome_length, segments FROM r WHERE k = 1")
def q_one_per_group(spark, d):
    """One random genome per clade (here the leading digits of the accession number)."""
    g = genomes(spark, d).withColumn("clade", F.substring("accession", 5, 4))
    return sm.one_per_group(g, ["clade"], "accession", 3)


@query(GENOMES + ", r AS (SELECT accession, row_number() OVER (ORDER BY md5(accession || '|42'), accession) AS r, count(*) OVER () AS n FROM gen) SELECT accession, CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'dev' ELSE 'test' END AS split FROM r")
def q_group_split(spark, d):
    return sm.group_split(genomes(spark, d), "accession", 42)


@query("""WITH s AS (SELECT DISTINCT segment_id, regexp_extract(segment_id, '(GC[AF]_[0-9]+\\.[0-9]+)', 1) AS genome, 'train' AS split FROM train UNION SELECT DISTINCT segment_id, regexp_extract(segment_id, '(GC[AF]_[0-9]+\\.[0-9]+)', 1), 'val' FROM val UNION SELECT DISTINCT segment_id, regexp_extract(segment_id, '(GC[AF]_[0-9]+\\.[0-9]+)', 1), 'test' FROM test),
 g AS (SELECT DISTINCT genome, split FROM s WHERE genome <> '') SELECT a.split AS split_a, b.split AS split_b, count(*) AS genomes FROM g a JOIN g b ON a.genome = b.genome AND a.split < b.split GROUP BY ALL""")
def q_split_overlap(spark, d):
    """Genomes that two splits have in common; disjoint splits give no rows."""
    g = None
    for s in ("train", "val", "test"):
        part = read(spark, d, s).select(genome_of("segment_id").alias("genome"), F.lit(s).alias("split")).filter("genome IS NOT NULL").distinct()
        g = part if g is None else g.unionByName(part)
    a, b = g.select("genome", F.col("split").alias("split_a")), g.select("genome", F.col("split").alias("split_b"))
    return a.join(b, "genome").filter("split_a < split_b").groupBy("split_a", "split_b").agg(F.count("*").alias("genomes"))


@query(GENOMES + ", r AS (SELECT accession, row_number() OVER (ORDER BY md5(accession || '|8'), accession) AS r, count(*) OVER () AS n FROM gen) SELECT accession, CAST(1000 // n + CASE WHEN r <= 1000 % n THEN 1 ELSE 0 END AS BIGINT) AS n FROM r")
def q_even_allocation(spark, d):
    return sm.even_allocation(genomes(spark, d), "accession", 1000, 8)


@query(META + ", r AS (SELECT segment_id, accession, row_number() OVER (PARTITION BY accession ORDER BY md5(segment_id || '|1'), segment_id) AS k FROM meta WHERE accession IS NOT NULL) SELECT segment_id, accession FROM r WHERE k <= 5")
def q_capped_per_genome(spark, d):
    return sm.capped(meta(spark, d).filter("accession IS NOT NULL").select("segment_id", "accession"), ["accession"], "segment_id", 5, 1)


@query(GENOMES + " SELECT accession, CAST(CASE WHEN genome_length < 500 THEN 0 WHEN genome_length < 2000 THEN 1 ELSE genome_length // 2000 END AS BIGINT) AS n FROM gen WHERE genome_length IS NOT NULL")
def q_samples_per_genome(spark, d):
    return genomes(spark, d).filter("genome_length IS NOT NULL").select("accession", sm.samples_per_length("genome_length", 2000, 500).cast("bigint").alias("n"))


@query(META + ", r AS (SELECT segment_id, row_number() OVER (ORDER BY md5(segment_id || '|17'), segment_id) AS place FROM meta) SELECT segment_id, place FROM r WHERE place <= 100")
def q_random_hundred(spark, d):
    """A seeded random top hundred, with the places."""
    t = sm.take(meta(spark, d).select("segment_id"), "segment_id", 100, 17)
    return t.withColumn("place", F.row_number().over(Window.orderBy(sm.seeded("segment_id", 17), "segment_id")).cast("bigint"))


@query(META + ", f AS (SELECT segment_id, CAST(CAST('0x' || substr(md5(segment_id || '|6'), 1, 8) AS BIGINT) % 5 AS INT) AS fold FROM meta) SELECT fold, count(*) AS rows, count(DISTINCT segment_id) AS ids FROM f GROUP BY fold")
def q_folds(spark, d):
    return sm.folds(meta(spark, d).select("segment_id"), "segment_id", 5, 6).groupBy("fold").agg(F.count("*").alias("rows"), F.countDistinct("segment_id").alias("ids"))


@query()
def q_random_segments(spark, d):
    """Random segments of 2,000 bases that don't overlap, up to five per genome."""
    g = genomes(spark, d).filter("genome_length IS NOT NULL").withColumn("n", F.least(F.lit(5), sm.samples_per_length("genome_length", 2000, 500)))
    return sm.random_segments(g, "accession", "genome_length", "n", 2000, 4)


_ALLOCATION = GENOMES + """, k AS (SELECT substr(accession, 5, 3) AS clade, count(*) AS c FROM gen GROUP BY 1), w AS (SELECT least(20, sum(c))::BIGINT AS total, sum(c)::BIGINT AS whole FROM k),
 f AS (SELECT clade, c, total, least(c, greatest(1, total * c // whole)) AS n FROM k, w), m AS (SELECT *, total - sum(n) OVER () AS missing, row_number() OVER (ORDER BY n < c DESC, c DESC, clade) AS place FROM f),
 al AS (SELECT clade, CAST(n + CASE WHEN n < c AND place <= missing THEN 1 ELSE 0 END AS BIGINT) AS n FROM m)"""


@query(_ALLOCATION + " SELECT * FROM al")
def q_proportional_allocation(spark, d):
    """Twenty genomes over the clades in proportion, each at least once (the SQL holds where no share has to be taken back and one turn deals out the rest)."""
    g = genomes(spark, d).withColumn("clade", F.substring("accession", 5, 3))
    counts = g.groupBy("clade").agg(F.count("*").alias("c"))
    return sm.allocated(counts, "clade", "c", 20)


@query(_ALLOCATION + """, h AS (SELECT accession, substr(accession, 5, 3) AS clade, substr(accession, 5, 5) AS genus, md5(accession || '|2') AS h FROM gen), r AS (SELECT *, row_number() OVER (PARTITION BY clade, genus ORDER BY h, accession) AS round FROM h),
 p AS (SELECT *, row_number() OVER (PARTITION BY clade ORDER BY round, h, accession) AS k FROM r) SELECT p.clade, genus, accession FROM p JOIN al ON al.clade = p.clade WHERE k <= n""")
def q_spread_selection(spark, d):
    g = genomes(spark, d).withColumns({"clade": F.substring("accession", 5, 3), "genus": F.substring("accession", 5, 5)})
    alloc = sm.allocated(g.groupBy("clade").agg(F.count("*").alias("c")), "clade", "c", 20)
    return sm.spread_first(g, "clade", "genus", "accession", alloc, 2).select("clade", "genus", "accession")


@query()
def q_coverage_segments(spark, d):
    g = genomes(spark, d).filter("genome_length IS NOT NULL")
    return sm.coverage_segments(g, "accession", "genome_length", 0.01, 4000, 500, 12)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'A' || assembly AS a, coalesce('C' || nullif(upper(regexp_replace(ncbi_id, '^\\s+|\\s+$', '', 'g')), ''), 'A' || assembly) AS b FROM known_prophages WHERE assembly <> ''),
 s AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e), r(n, m) AS (SELECT a, b FROM s UNION SELECT r.n, s.b FROM r JOIN s ON s.a = r.m) SELECT n AS node, min(m) AS component FROM r GROUP BY n""")
def q_connected_components(spark, d):
    """Assemblies and contigs that name each other, with the least name of their component."""
    k = read(spark, d, "known_prophages").filter("assembly <> ''")
    a = F.concat(F.lit("A"), "assembly")
    return graph.connected_components(k.select(a.alias("src"), F.coalesce(F.concat(F.lit("C"), contig_name("ncbi_id")), a).alias("dst")))


@query("WITH k AS (SELECT DISTINCT organism_name FROM known_prophages WHERE organism_name IS NOT NULL) SELECT organism_name, split_part(organism_name, ' ', 1) AS genus FROM k")
def q_genus(spark, d):
    k = read(spark, d, "known_prophages").filter("organism_name IS NOT NULL").select("organism_name").distinct()
    return k.select("organism_name", F.split("organism_name", " ")[0].alias("genus"))


_NAMES = "WITH k AS (SELECT DISTINCT assembly FROM known_prophages WHERE assembly <> '')"


@query(_NAMES + """ SELECT assembly, regexp_replace(assembly, '^(GB|RS)_', '') AS bare, coalesce(nullif(regexp_extract(assembly, '(GC[AF]_[0-9]+\\.[0-9]+)', 1), ''), nullif(regexp_extract(assembly, '(NC_[0-9]+)', 1), ''), split_part(assembly, '_', 1)) AS name,
 nullif(regexp_extract(assembly, '(?:^|[^0-9])([0-9]{9})(?:[^0-9]|$)', 1), '') AS number FROM k""")
def q_accession_names(spark, d):
    k = read(spark, d, "known_prophages").filter("assembly <> ''").select("assembly").distinct()
    return k.select("assembly", an.bare_accession("assembly").alias("bare"), an.assembly_of("assembly").alias("name"), accession_number("assembly").alias("number"))


_DOC = PRED + TRUTH + """, t AS (SELECT seq_id, count(*) AS known, CAST(sum("end" - start) AS BIGINT) AS known_bases FROM tru GROUP BY seq_id), o AS (SELECT upper(trim(ncbi_id)) AS seq_id, min(organism_name) AS organism FROM known_prophages WHERE ncbi_id IS NOT NULL GROUP BY 1),
 m AS (SELECT seq_id, count(*) AS rows, count(DISTINCT model) AS models, max("end") AS length FROM pred WHERE seq_id IS NOT NULL GROUP BY seq_id) SELECT m.seq_id, rows, models, length, coalesce(organism, '') AS organism, coalesce(known, 0) AS known, coalesce(known_bases, 0) AS known_bases FROM m LEFT JOIN o USING (seq_id) LEFT JOIN t USING (seq_id)"""


@query(_DOC)
def q_contig_summary(spark, d):
    """One row per contig from predictions, organism and known prophages, with empty values where one is missing."""
    m = predictions(spark, d).filter("seq_id IS NOT NULL").groupBy("seq_id").agg(F.count("*").alias("rows"), F.countDistinct("model").alias("models"), F.max("end").alias("length"))
    o = read(spark, d, "known_prophages").select(contig_name("ncbi_id").alias("seq_id"), "organism_name").filter("seq_id IS NOT NULL").groupBy("seq_id").agg(F.min("organism_name").alias("organism"))
    t = truth(spark, d).groupBy("seq_id").agg(F.count("*").alias("known"), F.sum(F.col("end") - F.col("start")).alias("known_bases"))
    out = m.join(o, "seq_id", "left").join(t, "seq_id", "left")
    return out.select("seq_id", "rows", "models", "length", F.coalesce("organism", F.lit("")).alias("organism"), F.coalesce("known", F.lit(0)).alias("known"), F.coalesce("known_bases", F.lit(0)).alias("known_bases"))


@query()
def q_genome_documents(spark, d):
    """One nested JSON document per contig: ground truth, metrics and called regions by model."""
    from windrow.operators.metrics import confusion_by
    from windrow.operators.signal import regions
    from windrow.plans.genome import windows

    w = windows(spark, d)
    metrics = confusion_by(w, ["seq_id", "model"]).groupBy("seq_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", F.struct("tp", "tn", "fp", "fn", "mcc", "f1"))))).alias("metrics"))
    called = regions(w.filter("pred = 1"), ["seq_id", "model"], 3000, 1000)
    called = called.groupBy("seq_id", "model").agg(F.array_sort(F.collect_list(F.struct("start", "end", "avg_score"))).alias("r"))
    called = called.groupBy("seq_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "r")))).alias("clustered_predictions"))
    known = truth(spark, d).groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ground_truth"))
    base = q_contig_summary(spark, d).select("seq_id", "organism", F.col("length").alias("genome_length"))
    j = base.join(known, "seq_id", "left").join(metrics, "seq_id", "left").join(called, "seq_id", "left")
    j = j.withColumn("ground_truth", F.coalesce("ground_truth", F.array().cast("array<struct<start:bigint,end:bigint>>")))
    return j.select("seq_id", F.to_json(F.struct(*j.columns)).alias("document"))


@query("SELECT c_custkey, c_mktsegment, NULL::DOUBLE AS s_acctbal FROM customer WHERE c_nationkey < 3 UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier WHERE s_nationkey < 3")
def q_union_unequal(spark, d):
    """Tables with different columns one below the other; missing ones are null."""
    a = read(spark, d, "customer").filter("c_nationkey < 3").select("c_custkey", "c_mktsegment")
    b = read(spark, d, "supplier").filter("s_nationkey < 3").select(F.col("s_suppkey").alias("c_custkey"), "s_acctbal")
    return a.unionByName(b, allowMissingColumns=True).select("c_custkey", "c_mktsegment", F.col("s_acctbal").cast("double").alias("s_acctbal"))


@query("SELECT 'both' AS kind, k FROM (SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer) UNION ALL SELECT 'nation only', k FROM (SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier)")
def q_set_operations(spark, d):
    s, c, n = read(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), read(spark, d, "customer").select("c_nationkey"), read(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    return s.intersect(c).select(F.lit("both").alias("kind"), "k").unionByName(n.subtract(s).select(F.lit("nation only").alias("kind"), "k"))


@query("SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 4) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def q_dimension_rollup(spark, d):
    j = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rounded(j.groupBy("r_name", "n_name").agg(F.count("*").alias("customers"), F.sum("c_acctbal").alias("balance")), 4)


@query("WITH e AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS place FROM e) SELECT event_type, place, user_id, n FROM t WHERE place <= 5")
def q_top_users(spark, d):
    e = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    t = e.withColumn("place", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("n"), "user_id")))
    return t.filter("place <= 5").select("event_type", F.col("place").cast("bigint").alias("place"), "user_id", "n")
