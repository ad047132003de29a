"""Queries over sources and sinks: rows of the tables are written as files in the shared folder and read back by their readers.

What is read must be what the tables hold, so the SQL of each query works on the tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from windrow.functions.sequences import clean_bases
from windrow.sources import fasta, tables
from windrow.storage import remember, shared_dir

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def folder(spark) -> str:
    """A new path in the shared folder, deleted when the process ends."""
    path = f"{shared_dir(spark)}/windrow/files-{uuid.uuid4().hex}"
    remember(path, spark)
    return path


def records(spark, d, table="test"):
    """One row per segment_id with its bases."""
    t = read(spark, d, table).select("segment_id", clean_bases("sequence").alias("sequence")).filter("segment_id IS NOT NULL AND sequence <> ''")
    return t.groupBy("segment_id").agg(F.max("sequence").alias("sequence"))


_REC = "WITH rec AS (SELECT segment_id, max(s) AS sequence FROM (SELECT segment_id, upper(regexp_replace(sequence, '[^A-Za-z]', '', 'g')) AS s FROM {t}) WHERE segment_id IS NOT NULL AND s <> '' GROUP BY segment_id)"
REC = _REC.format(t="test")


def _fasta(spark, rows, one_file=False, width=60):
    path = folder(spark)
    rows = rows.withColumn("about", F.concat(F.lit("length>="), F.length("sequence").cast("string"), F.lit(" 5 prime ->3 prime")))
    if one_file:
        rows = rows.coalesce(1).sortWithinPartitions("segment_id")
    fasta.write_fasta(rows, path, "segment_id", "sequence", width, description_col="about")
    return path


@query(REC + " SELECT segment_id AS seq_id, 'length>=' || length(sequence) || ' 5 prime ->3 prime' AS description, sequence FROM rec")
def q_fasta_round_trip(spark, d):
    """Records written as wrapped FASTA and read again, with a > within the headers."""
    return fasta.read_fasta(spark, _fasta(spark, records(spark, d))).select("seq_id", "description", "sequence")


@query(REC + " SELECT segment_id AS contig_id, 1 AS n FROM rec")
def q_fasta_headers(spark, d):
    return fasta.headers(spark, _fasta(spark, records(spark, d))).groupBy("contig_id").agg(F.count("*").alias("n"))


@query(REC + " SELECT min(segment_id) AS seq_id, count(*) AS contigs, sum(length(sequence))::BIGINT AS length FROM rec")
def q_fasta_genome_length(spark, d):
    """First header, number of records and bases of a file, without putting sequences together."""
    return fasta.genome_lengths(spark, _fasta(spark, records(spark, d), True)).select("seq_id", "contigs", "length")


@query(REC + " SELECT segment_id AS seq_id, sequence FROM rec ORDER BY length(sequence) DESC, segment_id LIMIT 1")
def q_fasta_longest(spark, d):
    """The longest record of a file, the first of equals."""
    return fasta.longest_per_file(fasta.read_fasta(spark, _fasta(spark, records(spark, d), True))).select("seq_id", "sequence")


@query(REC + " SELECT segment_id AS seq_id, length(sequence) AS length, round(length(regexp_replace(sequence, '[^GC]', '', 'g')) / length(sequence), 9) AS gc FROM rec ORDER BY segment_id LIMIT 1")
def q_fasta_first_record(spark, d):
    return fasta.first_records(spark, _fasta(spark, records(spark, d), True)).select("seq_id", F.col("length").cast("bigint").alias("length"), F.round("gc", 9).alias("gc"))


@query(REC + " SELECT segment_id || '_fwd' AS seq_id, sequence FROM rec UNION ALL SELECT segment_id || '_rev', reverse(translate(sequence, 'ACGT', 'TGCA')) FROM rec")
def q_fasta_strands(spark, d):
    """Every record and its reverse complement, named as a pair."""
    both = fasta.both_strands(fasta.read_fasta(spark, _fasta(spark, records(spark, d))))
    return both.select(F.concat("seq_id", F.when(F.col("orientation") == "forward", "_fwd").otherwise("_rev")).alias("seq_id"), "sequence")


@query(REC + ", n AS (SELECT *, row_number() OVER (ORDER BY segment_id) - 1 AS k FROM rec) SELECT 'r' || CAST(k % 50 AS BIGINT) AS seq_id, arg_max(sequence, k) AS sequence FROM n GROUP BY 1")
def q_fasta_last_per_id(spark, d):
    """Of records with the same id the last one of the file counts."""
    from windrow.operators.selection import placed

    rows = placed(records(spark, d), "segment_id").select(F.concat(F.lit("r"), (F.col("place") % 50).cast("string")).alias("id"), "sequence", "place")
    path = folder(spark)
    fasta.write_fasta(rows.coalesce(1).sortWithinPartitions("place"), path, "id", "sequence", 70)
    return fasta.last_per_id(fasta.read_fasta(spark, path)).select("seq_id", "sequence")


@query(REC + " SELECT segment_id AS seq_id, CAST(greatest(0, least(-7, length(sequence) - 64)) AS BIGINT) AS start, CAST(least(greatest(0, least(-7, length(sequence) - 64)) + 64, length(sequence)) AS BIGINT) AS \"end\", substr(sequence, 1, 64) AS sequence FROM rec")
def q_fasta_fetch(spark, d):
    """Intervals at the very beginning, widened to 64 bases and shifted into the record."""
    r = fasta.read_fasta(spark, _fasta(spark, records(spark, d)))
    cut = r.select("seq_id", F.lit(20).cast("bigint").alias("start"), F.lit(30).cast("bigint").alias("end"))
    return fasta.fetch(cut, r, 64).select("seq_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "sequence")


@query("""WITH p AS (SELECT segment_id, coalesce(seq_id, '-') AS seq_id, prob_1 FROM predictions WHERE segment_id IS NOT NULL) SELECT seq_id AS sseqid, count(*) FILTER (prob_1 IS NOT NULL AND NOT isnan(prob_1)) AS good, count(*) FILTER (prob_1 IS NULL) AS few, count(*) FILTER (isnan(prob_1)) AS unread FROM p GROUP BY seq_id""")
def q_blast_rows(spark, d):
    """Alignment rows per subject: good ones, those with too few columns and those with a number that can't be read."""
    p = read(spark, d, "predictions").filter("segment_id IS NOT NULL").select("segment_id", F.coalesce("seq_id", F.lit("-")).alias("s"), "prob_1")
    value = F.when(F.isnan("prob_1"), "x").otherwise(F.format_string("%.3f", F.col("prob_1") * 100))
    line = F.concat_ws("\t", "segment_id", "s", value, *(F.lit(x) for x in ("200", "1", "0", "1", "200", "1", "200", "1e-30", "400")))
    path = folder(spark)
    p.select(F.when(F.col("prob_1").isNull(), F.concat_ws("\t", "segment_id", "s")).otherwise(line).alias("value")).write.text(path)
    good, bad = tables.read_delimited(spark, path, tables.BLAST_STANDARD)
    good = good.select("sseqid", F.lit("good").alias("kind"))
    bad = bad.select(F.split("line", "\t")[1].alias("sseqid"), F.when(F.col("message").startswith("expected"), "few").otherwise("unread").alias("kind"))
    return good.unionByName(bad).groupBy("sseqid").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("good", "few", "unread")))


_PLACES = "SELECT DISTINCT upper(trim(ncbi_id)) AS seq_id, least(start, \"end\") AS start, greatest(start, \"end\") AS \"end\", trim(organism_name) AS organism FROM known_prophages WHERE trim(ncbi_id) <> '' AND start <> \"end\""


def _places(spark, d):
    k = read(spark, d, "known_prophages").filter("trim(ncbi_id) <> '' AND start <> end")
    return k.select(F.upper(F.trim("ncbi_id")).alias("seq_id"), F.least("start", "end").alias("start"), F.greatest("start", "end").alias("end"), F.trim("organism_name").alias("organism")).distinct()


@query(f"WITH k AS ({_PLACES}) SELECT seq_id AS seqid, start, \"end\", '+' AS strand, 'p' || start AS id, nullif(replace(replace(organism, ';', ','), '=', ' '), '') AS product, 'tail' AS gene, NULL::VARCHAR AS note, 'L_' || \"end\" AS locus_tag FROM k")
def q_gff_features(spark, d):
    """Coding features of GFF3 with their attributes; other kinds and comments are skipped."""
    organism = F.coalesce(F.translate("organism", ";=", ", "), F.lit(""))
    attributes = F.concat(F.lit("ID=p"), F.col("start").cast("string"), F.lit(";product="), organism, F.lit(";Name=tail;locus_tag=L_"), F.col("end").cast("string"))
    row = lambda kind: F.concat_ws("\t", "seq_id", F.lit("caller"), F.lit(kind), F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), F.lit("+"), F.lit("0"), attributes)
    path = folder(spark)
    _places(spark, d).select(F.explode(F.array(F.lit("##gff-version 3"), row("CDS"), row("gene"))).alias("value")).write.text(path)
    return tables.read_gff(spark, path).withColumn("product", F.nullif("product", F.lit("")))


@query(f"WITH k AS ({_PLACES}) SELECT DISTINCT seq_id, start, \"end\" FROM k")
def q_bed_round_trip(spark, d):
    """Regions written as BED with six columns and read by the first four."""
    path = folder(spark)
    tables.write_bed(_places(spark, d).select("seq_id", "start", "end").distinct(), path, ["seq_id"])
    good, _ = tables.read_delimited(spark, path, tables.BED)
    return good.select("seq_id", "start", "end")


@query("SELECT n_name AS locus, n_name || ' protein' AS product, 'K' || n_regionkey AS cog_category, 'COG' || n_nationkey AS cog_id FROM nation")
def q_annotation_json(spark, d):
    """Coding features of annotation JSON, categories at either place; one file per region."""
    n = read(spark, d, "nation")
    cog = F.struct(F.concat(F.lit("K"), F.col("n_regionkey").cast("string")).alias("cog_category"), F.concat(F.lit("COG"), F.col("n_nationkey").cast("string")).alias("cog_id"))
    deep = F.struct(F.lit("cds").alias("type"), F.col("n_name").alias("locus"), F.concat("n_name", F.lit(" protein")).alias("product"), F.when(F.col("n_nationkey") % 2 == 0, cog).alias("psc"), F.when(F.col("n_nationkey") % 2 == 1, cog.cog_category).alias("cog_category"), F.when(F.col("n_nationkey") % 2 == 1, cog.cog_id).alias("cog_id"))
    other = F.struct(F.lit("trna").alias("type"), F.lit("t").alias("locus"), *(F.lit(None).cast(t).alias(c) for c, t in (("product", "string"), ("psc", "struct<cog_category:string,cog_id:string>"), ("cog_category", "string"), ("cog_id", "string"))))
    docs = n.groupBy("n_regionkey").agg(F.collect_list(deep).alias("f")).select("n_regionkey", F.to_json(F.struct(F.array_append("f", other).alias("features"))).alias("value"))
    path = folder(spark)
    docs.write.partitionBy("n_regionkey").text(path)
    return tables.read_bakta(spark, f"{path}/*").drop("source_file")


@query("SELECT round(n_nationkey / 100, 6) AS f1, round(n_nationkey / 50, 6) AS mcc FROM nation")
def q_metric_files(spark, d):
    """Metric JSON, nested and flat, one file per run; summaries are left out."""
    n = read(spark, d, "nation")
    f1, mcc = (F.col("n_nationkey") / 100).alias("f1"), (F.col("n_nationkey") / 50).alias("mcc")
    text = F.when(F.col("n_nationkey") % 2 == 0, F.to_json(F.struct(F.struct(f1, mcc).alias("simple_metrics")))).otherwise(F.to_json(F.struct(f1, mcc)))
    path = folder(spark)
    n.select("n_nationkey", text.alias("value")).write.partitionBy("n_nationkey").text(path)
    return tables.read_metrics(spark, f"{path}/*").select(F.round("f1", 6).alias("f1"), F.round("mcc", 6).alias("mcc"))


@query("""WITH p AS (SELECT *, dense_rank() OVER (ORDER BY model) % 3 AS layout FROM predictions WHERE model IS NOT NULL AND prob_0 IS NOT NULL AND prob_1 IS NOT NULL AND NOT isnan(prob_0) AND NOT isnan(prob_1) AND pred_label IS NOT NULL)
SELECT model, 'cat' AS category, '2k' AS "window", 'genome_' || layout AS input_file, count(*) AS n, count(CASE WHEN layout <> 1 THEN seq_id END) AS contigs, count(CASE WHEN layout <> 1 THEN start END) AS starts, count(CASE WHEN layout <> 2 THEN label END) AS labels, count(segment_id) AS segments, round(sum(prob_1), 6) AS prob_1, sum(pred_label)::BIGINT AS positives FROM p GROUP BY ALL""")
def q_prediction_folders(spark, d):
    """Result files found by their folders, with different columns in different order; what a file lacks is null."""
    whole = "prob_0 IS NOT NULL AND prob_1 IS NOT NULL AND NOT isnan(prob_0) AND NOT isnan(prob_1) AND pred_label IS NOT NULL"
    p = read(spark, d, "predictions").filter(f"model IS NOT NULL AND {whole}")
    models = sorted(r[0] for r in p.select("model").distinct().collect())  # a folder each
    layouts = {
        0: ["sequence", "pred_label", "prob_1", "prob_0", "end", "start", "label", "segment_id", "seq_id"], 1: ["segment_id", "prob_0", "prob_1", "pred_label", "label"],
        2: ["segment_id", "seq_id", "start", "end", "prob_0", "prob_1", "pred_label"],
    }
    root, hadoop = folder(spark), spark.sparkContext._jvm.org.apache.hadoop.fs
    for i, model in enumerate(models):
        layout = (i + 1) % 3
        rows = p.filter(F.col("model") == model).withColumn("sequence", F.lit('AC"GT,A')).select(*layouts[layout])
        at = f"{root}/{model}/cat/2k"
        tables.write_delimited(rows.coalesce(1), f"{root}/_written/{model}/2k")
        system = hadoop.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(hadoop.Path(at))
        part = next(s.getPath() for s in system.listStatus(hadoop.Path(f"{root}/_written/{model}/2k")) if s.getPath().getName().endswith(".csv"))
        system.rename(part, hadoop.Path(f"{at}/genome_{layout}_predictions.csv"))
    r = tables.read_predictions(spark, root)
    n = lambda c: F.count(F.nullif(c, F.lit("")))
    return r.groupBy("model", "category", "window", "input_file").agg(
        F.count("*").alias("n"), n("seq_id").alias("contigs"), n("start").alias("starts"), n("label").alias("labels"), n("segment_id").alias("segments"),
        F.round(F.sum(F.col("prob_1").cast("double")), 6).alias("prob_1"), F.sum(F.col("pred_label").cast("bigint")).alias("positives"))


@query("WITH c AS (SELECT DISTINCT contig_id AS genome, ascii(substr(contig_id, -3, 1)) % 7 AS cluster FROM contig_map WHERE contig_id IS NOT NULL) SELECT CAST(cluster AS INT) AS cluster, min(genome) AS genome, count(*) AS members FROM c GROUP BY cluster")
def q_cluster_file(spark, d):
    """The genome that comes first in the file stands for its cluster."""
    c = read(spark, d, "contig_map").filter("contig_id IS NOT NULL").select(F.col("contig_id").alias("genome"), (F.ascii(F.substring("contig_id", -3, 1)) % 7).alias("cluster")).distinct()
    path = folder(spark)
    tables.write_delimited(c.coalesce(1).sortWithinPartitions("genome"), path, sep="\t")
    return tables.first_of_clusters(tables.read_clusters(spark, path))


@query("SELECT n_name AS query, r_name AS reference, round(n_nationkey / 1000, 6) AS distance FROM nation, region")
def q_distance_file(spark, d):
    """Distances between genomes named by files."""
    n, r = read(spark, d, "nation"), read(spark, d, "region")
    rows = n.crossJoin(F.broadcast(r)).select(F.concat(F.lit("/x/y/"), "n_name", F.lit(".fna.gz")), F.concat(F.lit("/z/"), "r_name", F.lit(".fa")), F.format_string("%.6f", F.col("n_nationkey") / 1000), F.lit("0"), F.lit("9/10"))  # 25 rows and 5
    path = folder(spark)
    tables.write_delimited(rows, path, sep="\t", header=False)
    return tables.read_mash(spark, path)


@query("SELECT segment_id, round(prob_1, 3) AS prob_1, label FROM predictions WHERE segment_id IS NOT NULL AND prob_1 IS NOT NULL AND NOT isnan(prob_1)")
def q_fixed_digits(spark, d):
    """A CSV with three digits, read by its schema; null stays null."""
    p = read(spark, d, "predictions").filter("segment_id IS NOT NULL AND prob_1 IS NOT NULL AND NOT isnan(prob_1)").select("segment_id", F.round("prob_1", 3).alias("prob_1"), "label")
    path = folder(spark)
    tables.write_delimited(p, path, digits=3)
    return tables.read_csv(spark, path, "segment_id string, prob_1 double, label int")


@query("SELECT lower(trim(split)) AS split, segment_id, length(sequence) AS bases FROM (SELECT 'train' AS split, segment_id, sequence FROM train UNION ALL SELECT 'dev', segment_id, sequence FROM val UNION ALL SELECT 'test', segment_id, sequence FROM test) WHERE segment_id IS NOT NULL AND sequence <> ''")
def q_split_folder(spark, d):
    """train, val and test CSV of a folder; cells may hold line breaks."""
    root = folder(spark)
    for name in ("train", "val", "test"):
        t = read(spark, d, name).filter("segment_id IS NOT NULL AND sequence <> ''").select("segment_id", "sequence")
        t.write.csv(f"{root}/{name}.csv", header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return tables.read_splits(spark, root, "segment_id string, sequence string").select("split", "segment_id", F.length("sequence").cast("bigint").alias("bases"))
