"""Choosing records and genomes: quality, contamination, best hits, audits between tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.functions.annotations import bare_accession, contains_any
from windrow.storage import materialize


def representatives(meta: DataFrame, completeness: float = 95.0, contamination: float = 5.0) -> DataFrame:
    """Genomes that represent their species and pass the quality limits."""
    own = F.col("accession") == F.col("gtdb_genome_representative")
    return meta.filter(own & (F.col("checkm2_completeness") >= completeness) & (F.col("checkm2_contamination") <= contamination))


def strong_hits(hits: DataFrame, identity: float = 90.0, length: int = 200) -> DataFrame:
    return hits.filter((F.col("pident") >= identity) & (F.col("length") >= length))


def hit_genomes(hits: DataFrame, contig_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Genomes with a hit (accession), and contigs of hits that the map lacks (contig_id)."""
    contigs = hits.select(F.col("sseqid").alias("contig_id")).distinct()
    known = contig_map.select("contig_id", bare_accession("genome_accession").alias("accession")).distinct()
    return contigs.join(known, "contig_id").select("accession").distinct(), contigs.join(known, "contig_id", "left_anti")


def clean_genomes(genomes: DataFrame, contaminated: DataFrame) -> DataFrame:
    """Genomes without any hit; accessions are compared without prefixes."""
    bad = contaminated.select(bare_accession("accession").alias("_a")).distinct()
    return genomes.withColumn("_a", bare_accession("accession")).join(bad, "_a", "left_anti").drop("_a")


def best_hits(hits: DataFrame, drop_self: bool = False) -> DataFrame:
    """The hit with the greatest bitscore of each query; the greater identity, then the lesser subject on ties."""
    rows = hits.filter("qseqid <> sseqid") if drop_self else hits
    rest = [c for c in rows.columns if c != "qseqid"]
    best = F.min_by(F.struct(*rest), F.struct(-F.col("bitscore"), -F.col("pident"), F.col("sseqid")))
    return rows.groupBy("qseqid").agg(best.alias("r")).select("qseqid", "r.*")


def leak_counts(best: DataFrame, thresholds: tuple[float, ...] = (50, 70, 80, 90, 95), coverage: float = 50.0) -> DataFrame:
    """Queries whose best hit reaches each identity at a coverage: one row per threshold, from one pass."""
    per = best.agg(F.count("*").alias("queries"), *(F.count_if((F.col("pident") >= t) & (F.col("qcovs") >= coverage)).alias(f"_{i}") for i, t in enumerate(thresholds)))
    rows = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_{i}").alias("leaked")) for i, t in enumerate(thresholds)))
    return per.select("queries", F.explode(rows).alias("r")).select("r.threshold", "r.leaked", "queries", F.try_divide("r.leaked", "queries").alias("share"))


def exclusion_reason(product: str, note: str, length: Column, low: int, high: int, overlapping: Column) -> Column:
    """Why a coding sequence is left out, by the first rule that fits; null if it isn't."""
    text = F.concat_ws(" ", product, note)
    return (
        F.when(length < low, "short").when(length > high, "long").when(contains_any(text), "phage keyword").when(overlapping, "overlaps a hit")
        .when(F.contains(F.lower(F.coalesce(F.col(product), F.lit(""))), F.lit("hypothetical")), "hypothetical")
    )


def first_contained(ids: DataFrame, tags: DataFrame, id_col: str, tag_col: str, pattern: str = r"[A-Za-z0-9]+_[0-9]+") -> DataFrame:
    """ids with the first tag (in order of place) that is contained in them: tags are cut out by their pattern and joined by equality."""
    parts = ids.select(id_col, F.posexplode(F.regexp_extract_all(F.col(id_col), F.lit(f"({pattern})"), 1)).alias("_p", tag_col))
    hit = parts.join(tags.select(tag_col).distinct(), tag_col)
    first = hit.groupBy(id_col).agg(F.min_by(tag_col, "_p").alias(tag_col))
    return ids.join(first, id_col, "left")


def fallback_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], value: str) -> DataFrame:
    """left with value of right by the first pair of keys (of left, of right) that finds one."""
    out = left
    for i, (a, b) in enumerate(keys):
        found = right.filter(F.col(b).isNotNull()).groupBy(F.col(b).alias(a)).agg(F.min(value).alias(f"_v{i}"))
        out = out.join(found, a, "left")
    return out.withColumn(value, F.coalesce(*(f"_v{i}" for i in range(len(keys))))).drop(*(f"_v{i}" for i in range(len(keys))))


def missing_both_ways(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys only left, only right, and on both sides."""
    a = left.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_a", F.lit(1))
    b = right.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_b", F.lit(1))
    j = a.join(b, key, "full")
    return j.agg(F.count_if(F.col("_b").isNull()).alias("only_left"), F.count_if(F.col("_a").isNull()).alias("only_right"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"))


def joined_by_place(left: DataFrame, left_order: str, right: DataFrame, right_order: str) -> DataFrame:
    """Rows of two tables side by side by their place in order."""
    return placed(left, left_order).join(placed(right, right_order), "place")


def placed(df: DataFrame, order: str | list[str]) -> DataFrame:
    """df with place, from 0, in order. Rows are range-partitioned and sorted; each partition's offset is the count before it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [order] if isinstance(order, str) else order
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    rows = rows.withColumn("_part", F.shiftright("_m", 33)).withColumn("_own", F.col("_m").bitwiseAND((1 << 33) - 1))
    rows = materialize(rows.drop("_m"), "placed")
    per = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    per = per.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return rows.join(per, "_part").withColumn("place", F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def locate(accessions: DataFrame, files: DataFrame) -> DataFrame:
    """accessions(accession) with the path of files(accession, path), of the other archive where their own has none, and found."""
    from windrow.functions.annotations import other_archive

    own = files.filter("accession IS NOT NULL").groupBy("accession").agg(F.min("path").alias("_own"))
    other = own.select(F.col("accession").alias("_alt"), F.col("_own").alias("_other"))
    rows = accessions.withColumn("_alt", other_archive("accession")).join(own, "accession", "left").join(other, "_alt", "left")
    return rows.withColumn("path", F.coalesce("_own", "_other")).withColumn("found", F.col("path").isNotNull()).drop("_alt", "_own", "_other")


def drop_containing(records: DataFrame, ids: DataFrame, column: str, id_col: str, pattern: str = r"GC[AF]_[0-9]+(?:\.[0-9]+)?") -> DataFrame:
    """Records whose column holds none of the ids: ids are cut out by their pattern and compared, with and without version."""
    version = r"\.[0-9]+$"
    bad = ids.select(F.explode(F.array(F.col(id_col), F.regexp_replace(id_col, version, ""))).alias("_k")).filter("_k IS NOT NULL").distinct()
    found = F.regexp_extract_all(F.col(column), F.lit(f"({pattern})"), 1)
    marks = records.select(column, F.explode(found).alias("_m")).select(column, F.explode(F.array(F.col("_m"), F.regexp_replace("_m", version, ""))).alias("_k"))
    return records.join(marks.join(bad, "_k").select(column).distinct(), column, "left_anti")


def in_range(df: DataFrame, value: str, ranges: DataFrame) -> DataFrame:
    """df with the columns of the row of ranges(low, high, ...) for which low < value <= high; of several the one with the least low.

    Only distinct values meet the ranges, of which there are few by nature (length classes).
    """
    rest = [c for c in ranges.columns if c not in ("low", "high")]
    values = df.select(F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL").distinct()
    hit = values.join(ranges, (F.col("low") < F.col("_v")) & (F.col("_v") <= F.col("high"))).groupBy("_v").agg(F.min(F.struct("low", "high", *rest)).alias("_r"))
    return df.withColumn("_v", F.col(value).cast("double")).join(hit, "_v", "left").select(*df.columns, *(F.col(f"_r.{c}").alias(c) for c in ("low", "high", *rest)))


def first_existing(spark, paths: list[str]) -> str | None:
    """The first of several places that exists."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return p
    return None
