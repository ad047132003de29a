"""Queries on the sequences of the splits and the genome-wide segments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.functions import sequences as sq
from windrow.plans.evaluation import rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: All tables with sequences; segment_id is unique across them.
ALL = ("train", "val", "test", "segments")


def over_all(f):
    """Register a query on val as NAME_all over all tables with sequences too, without SQL."""

    def run(spark, d):
        return f(spark, d, *ALL)

    run.__name__ = f"{f.__name__}_all"
    run.__doc__ = f.__doc__
    return run


def records(spark, d, *names):
    """(segment_id, sequence) of the tables (else of val), each once, in clean upper-case letters.

    The number of partitions is fixed, so that they aren't merged by their size: what follows multiplies the rows.
    """
    t = reduce(DataFrame.unionByName, (spark.read.parquet(f"{d}/{name}.parquet").select("segment_id", "sequence") for name in names or ("val",)))
    t = t.filter("segment_id IS NOT NULL AND sequence IS NOT NULL").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "segment_id")
    return t.groupBy("segment_id").agg(F.max(sq.clean_bases("sequence")).alias("sequence"))


REC = "WITH rec AS (SELECT segment_id, max(upper(regexp_replace(sequence, '[^A-Za-z]', '', 'g'))) AS sequence FROM {t} WHERE segment_id IS NOT NULL AND sequence IS NOT NULL GROUP BY segment_id)"
VAL, TRAIN = REC.format(t="val"), REC.format(t="train")


@query(TRAIN + " SELECT segment_id, length(sequence) AS bases, CASE WHEN length(sequence) > 0 THEN round(len(regexp_extract_all(sequence, '[GC]')) / length(sequence), 9) ELSE 0 END AS gc FROM rec")
def q_gc_content(spark, d):
    r = records(spark, d, "train")
    return rounded(r.select("segment_id", F.length("sequence").cast("bigint").alias("bases"), sq.gc_content("sequence").alias("gc")))


@query(VAL + " SELECT segment_id, md5(reverse(translate(sequence, 'ACGTacgt', 'TGCAtgca'))) AS reverse_md5 FROM rec")
def q_reverse_complement(spark, d):
    return records(spark, d).select("segment_id", F.md5(sq.reverse_complement("sequence")).alias("reverse_md5"))


@query(VAL + """, k AS (SELECT segment_id, unnest(list_transform(range(1, length(sequence) - 2), lambda i: substr(sequence, i, 4))) AS kmer FROM rec WHERE length(sequence) >= 4), c AS (SELECT segment_id, kmer, count(*) AS n FROM k WHERE regexp_matches(kmer, '^[ACGT]+$') GROUP BY ALL)
 SELECT segment_id, kmer, n, round(n / sum(n) OVER (PARTITION BY segment_id), 9) AS frequency FROM c""")
def q_kmer_frequencies(spark, d, *names):
    """Relative frequencies of overlapping words of four letters over A, C, G, T."""
    k = records(spark, d, *names).select("segment_id", F.explode(sq.kmers("sequence", 4)).alias("kmer")).filter(F.col("kmer").rlike("^[ACGT]+$"))
    c = k.groupBy("segment_id", "kmer").agg(F.count("*").alias("n"))
    total = c.groupBy("segment_id").agg(F.sum("n").alias("_t"))
    return rounded(c.join(total, "segment_id").select("segment_id", "kmer", "n", (F.col("n") / F.col("_t")).alias("frequency")))


@query("""WITH d AS (SELECT unnest(range(0, 256)) AS i) SELECT substr('ACGT', CAST(i // 64 + 1 AS INT), 1) || substr('ACGT', CAST(i // 16 % 4 + 1 AS INT), 1) || substr('ACGT', CAST(i // 4 % 4 + 1 AS INT), 1) || substr('ACGT', CAST(i % 4 + 1 AS INT), 1) AS kmer, CAST(i + 5 AS INT) AS number FROM d""")
def q_kmer_vocabulary(spark, d):
    return sq.all_kmers(spark, 4)


@query(VAL + """, s AS (SELECT segment_id, length(sequence) AS n FROM rec), w AS (SELECT segment_id, n, unnest(range(0, n, 500)) AS p FROM s WHERE n > 0) SELECT segment_id, p AS start, least(p + 1000, n) AS "end" FROM w WHERE least(p + 1000, n) - p >= 300 AND (p = 0 OR p - 500 + 1000 < n)""")
def q_sliding_windows(spark, d, *names):
    w = records(spark, d, *names).select("segment_id", F.explode(sq.sliding_windows(F.length("sequence"), 1000, 500, 300)).alias("w"))
    return w.select("segment_id", "w.start", "w.end")


@query(VAL + """, s AS (SELECT segment_id, length(sequence) AS n FROM rec), w AS (SELECT segment_id, n, unnest(range(0, n, 750)) AS p FROM s WHERE n > 0) SELECT segment_id, p AS start, least(p + 750, n) AS "end" FROM w WHERE least(p + 750, n) - p >= 100""")
def q_contiguous_segments(spark, d, *names):
    w = records(spark, d, *names).select("segment_id", F.explode(sq.contiguous_segments(F.length("sequence"), 750, 100)).alias("w"))
    return w.select("segment_id", "w.start", "w.end")


@query(VAL + """, k AS (SELECT segment_id, list_transform(range(1, length(sequence) - 4), lambda i: substr(sequence, i, 6)) AS ks FROM rec WHERE length(sequence) >= 6), x AS (SELECT segment_id, unnest(ks) AS w, unnest(range(1, len(ks) + 1)) AS i FROM k),
 n AS (SELECT segment_id, i, CASE WHEN regexp_matches(w, '^[ACGT]+$') THEN list_reduce(list_transform(string_split(translate(w, 'ACGT', '0123'), ''), lambda c: CAST(c AS BIGINT)), lambda a, b: a * 4 + b) + 5 ELSE 1 END AS id FROM x)
 SELECT segment_id, count(*) + 2 AS tokens, CAST(sum(id * i) AS BIGINT) AS checksum, count(*) FILTER (id = 1) AS unknown FROM n GROUP BY segment_id""")
def q_kmer_tokens(spark, d, *names):
    """Token vectors of overlapping words of six letters, told by their lengths and weighted sums."""
    ids = sq.tokenize("sequence", 6, max_unknown=1.0)
    t = records(spark, d, *names).filter(F.length("sequence") >= 6).select("segment_id", ids.alias("ids"))
    body = F.slice("ids", 2, F.size("ids") - 2)
    weigh = F.aggregate(F.transform(body, lambda x, i: x.cast("bigint") * (i + 1)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return t.select("segment_id", F.size("ids").cast("bigint").alias("tokens"), weigh.alias("checksum"), F.size(F.filter(body, lambda x: x == 1)).cast("bigint").alias("unknown"))


@query(VAL + """, c AS (SELECT segment_id, unnest(string_split(sequence, '')) AS c, unnest(range(1, length(sequence) + 1)) AS i FROM rec WHERE length(sequence) > 0), n AS (SELECT segment_id, i, CASE c WHEN 'A' THEN 7 WHEN 'C' THEN 8 WHEN 'G' THEN 9 WHEN 'T' THEN 10 WHEN 'N' THEN 11 ELSE 6 END AS id FROM c)
 SELECT segment_id, count(*) AS letters, CAST(sum(id * i) AS BIGINT) AS checksum FROM n GROUP BY segment_id""")
def q_letter_tokens(spark, d):
    t = records(spark, d).filter(F.length("sequence") > 0).select("segment_id", sq.letter_tokens("sequence").alias("ids"))
    weigh = F.aggregate(F.transform("ids", lambda x, i: x.cast("bigint") * (i + 1)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return t.select("segment_id", F.size("ids").cast("bigint").alias("letters"), weigh.alias("checksum"))


@query(VAL + """, c AS (SELECT segment_id, unnest(string_split(sequence, '')) AS c, unnest(range(0, length(sequence))) AS i FROM rec WHERE length(sequence) > 0) SELECT segment_id, string_agg(c, '' ORDER BY md5(segment_id || '|5|' || i), i) AS shuffled FROM c GROUP BY segment_id""")
def q_shuffled_letters(spark, d):
    """The letters of each record in random order; the composition stays."""
    return records(spark, d).filter(F.length("sequence") > 0).select("segment_id", sq.shuffled_letters("sequence", "segment_id", 5).alias("shuffled"))


@query(VAL + " SELECT segment_id, md5(regexp_replace(regexp_replace(sequence, '(.{80})', '\\1' || chr(10), 'g'), chr(10) || '$', '')) AS wrapped_md5 FROM rec")
def q_wrapped_fasta(spark, d):
    return records(spark, d).select("segment_id", F.md5(sq.wrapped("sequence", 80)).alias("wrapped_md5"))


@query(VAL + " SELECT segment_id, CASE WHEN md5(segment_id || '|9') < '8' THEN reverse(translate(sequence, 'ACGT', 'TGCA')) ELSE sequence END AS sequence FROM rec")
def q_strand_augmentation(spark, d):
    """Every second record, by a hash of its id, reverse-complemented."""
    flip = F.md5(F.concat("segment_id", F.lit("|9"))) < "8"
    return records(spark, d).select("segment_id", F.when(flip, sq.reverse_complement("sequence")).otherwise(F.col("sequence")).alias("sequence"))


@query(VAL + ", t AS (SELECT segment_id, length(sequence) AS bases, CASE WHEN length(sequence) < 500 THEN '<500' WHEN length(sequence) < 1000 THEN '500-999' WHEN length(sequence) < 2000 THEN '1000-1999' ELSE '>=2000' END AS band FROM rec) SELECT band, count(*) AS records, CAST(sum(bases) AS BIGINT) AS bases FROM t GROUP BY band")
def q_length_bands(spark, d):
    n = F.length("sequence")
    band = F.when(n < 500, "<500").when(n < 1000, "500-999").when(n < 2000, "1000-1999").otherwise(">=2000")
    return records(spark, d).groupBy(band.alias("band")).agg(F.count("*").alias("records"), F.sum(n).alias("bases"))


_GC = TRAIN + """, lab AS (SELECT segment_id, max(label) AS label FROM train WHERE segment_id IS NOT NULL GROUP BY segment_id), g AS (SELECT label, len(regexp_extract_all(sequence, '[GC]')) / length(sequence) AS gc FROM rec JOIN lab USING (segment_id) WHERE length(sequence) > 0 AND label IS NOT NULL),
 t AS (SELECT i / 200.0::DOUBLE AS threshold, p AS polarity FROM range(20, 181) a(i), (VALUES (1), (-1)) b(p)), h AS (SELECT CAST(round(gc * 1e9) AS BIGINT) AS gc, label, count(*) AS n FROM g GROUP BY ALL),
 c AS (SELECT threshold, polarity, sum(CASE WHEN label = 1 AND up THEN n ELSE 0 END) AS tp, sum(CASE WHEN label = 0 AND NOT up THEN n ELSE 0 END) AS tn, sum(CASE WHEN label = 0 AND up THEN n ELSE 0 END) AS fp, sum(CASE WHEN label = 1 AND NOT up THEN n ELSE 0 END) AS fn FROM (SELECT *, (gc >= CAST(round(threshold * 1e9) AS BIGINT)) = (polarity = 1) AS up FROM h, t) GROUP BY threshold, polarity),
 m AS (SELECT threshold, polarity, round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END, 9) AS mcc FROM c) SELECT threshold, polarity, mcc FROM m ORDER BY mcc DESC, threshold, polarity DESC LIMIT 1"""


@query(_GC)
def q_gc_threshold(spark, d):
    """The threshold (161 of them) and polarity of the GC share that best tells the labels apart, by mcc."""
    lab = spark.read.parquet(f"{d}/train.parquet").filter("segment_id IS NOT NULL").groupBy("segment_id").agg(F.max("label").alias("label"))
    g = records(spark, d, "train").filter(F.length("sequence") > 0).join(lab.filter("label IS NOT NULL"), "segment_id").select("label", sq.gc_content("sequence").alias("gc"))
    h = g.groupBy(F.round(F.col("gc") * 1e9).cast("bigint").alias("gc"), "label").agg(F.count("*").alias("n"))
    # a row counts for all thresholds up to its own: a histogram of 161 steps and its running sums
    step = F.greatest(F.lit(19), F.least(F.lit(180), F.floor(F.col("gc") / F.lit(5_000_000)))).cast("int")
    bins = h.groupBy(step.alias("i")).agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("q"))
    per = bins.agg(F.collect_list(F.struct("i", "p", "q")).alias("b"), F.sum("p").alias("P"), F.sum("q").alias("Q"))
    grid = per.withColumn("i", F.explode(F.sequence(F.lit(20), F.lit(180)))).withColumn("polarity", F.explode(F.array(F.lit(1), F.lit(-1))))
    over = lambda c: F.aggregate(F.filter("b", lambda x: x["i"] >= F.col("i")), F.lit(0).cast("bigint"), lambda a, x: a + x[c])
    c = grid.select((F.col("i") / F.lit(200.0)).alias("threshold"), "polarity", over("p").alias("hp"), over("q").alias("hq"), "P", "Q")
    up = F.col("polarity") == 1
    c = c.select("threshold", "polarity", F.when(up, F.col("hp")).otherwise(F.col("P") - F.col("hp")).alias("tp"), F.when(up, F.col("hq")).otherwise(F.col("Q") - F.col("hq")).alias("fp"), "P", "Q")
    from windrow.operators.metrics import rates

    c = rates(c.select("threshold", "polarity", "tp", (F.col("Q") - F.col("fp")).alias("tn"), "fp", (F.col("P") - F.col("tp")).alias("fn")))
    return rounded(c.select("threshold", "polarity", "mcc")).orderBy(F.desc("mcc"), "threshold", F.desc("polarity")).limit(1)


for _f in (q_kmer_frequencies, q_kmer_tokens, q_sliding_windows, q_contiguous_segments):
    query()(over_all(_f))
