"""Which assemblies belong together, and the groups of segments that follow from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.operators.graph import connected_components
from windrow.operators.intervals import accession_number, contig_name


def _unit(column: str) -> Column:
    """All spellings of an assembly with one accession number are one unit; one without stands for itself."""
    return F.coalesce(F.concat(F.lit("N"), accession_number(column)), F.concat(F.lit("A"), F.nullif(F.col(column), F.lit(""))))


def _links(df: DataFrame, assembly: str, contig: str) -> DataFrame:
    """Unit to contig; a unit without a contig is linked to itself."""
    links = df.select(_unit(assembly).alias("src"), F.concat(F.lit("C"), contig_name(contig)).alias("dst"))
    return links.filter("src IS NOT NULL").select("src", F.coalesce("dst", "src").alias("dst")).distinct()


def assembly_groups(known: DataFrame) -> DataFrame:
    """(assembly, group_id): assemblies as written that have an accession number or a contig in common, or a chain of such links.

    Null and empty assemblies are left out; repeated rows count once.
    """
    names = known.select("assembly", _unit("assembly").alias("node")).filter("node IS NOT NULL").distinct()
    groups = connected_components(_links(known, "assembly", "ncbi_id"))
    return names.join(groups, "node").select("assembly", F.col("component").alias("group_id"))


def related_pairs(groups: DataFrame) -> DataFrame:
    """(assembly_a, assembly_b): every two assemblies of a group, the smaller first."""
    a, b = (groups.select("group_id", F.col("assembly").alias(f"assembly_{x}")) for x in "ab")
    return a.join(b, "group_id").filter("assembly_a < assembly_b").select("assembly_a", "assembly_b")


def segment_groups(segments: DataFrame, known: DataFrame, contig_map: DataFrame) -> DataFrame:
    """(segment_id, label, group_id) of the labelled records of segments, one row per segment_id.

    A segment is in the group of the assemblies that known prophages or the contig map give for its contig;
    where they give none, of the accession number its segment_id starts with, then of its contig,
    then of itself. Rows of one segment_id are counted once, with the greatest label.
    """
    rows = segments.filter("segment_id IS NOT NULL AND label IS NOT NULL").groupBy("segment_id").agg(F.max("label").alias("label"), F.max(contig_name("seq_id")).alias("contig"))
    rows = rows.withColumn("node", F.concat(F.lit("C"), "contig"))
    links = _links(known, "assembly", "ncbi_id").unionByName(_links(contig_map, "genome_accession", "contig_id"))
    given = links.filter("src <> dst").select(F.col("dst").alias("node")).distinct().withColumn("given", F.lit(True))
    rows = rows.join(given, "node", "left")
    own = F.concat(F.lit("N"), accession_number(F.substring_index("segment_id", "_seg", 1)))
    rows = rows.withColumn("node", F.when(F.col("given"), F.col("node")).otherwise(F.coalesce(own, F.col("node"), F.concat(F.lit("S"), "segment_id"))))
    groups = connected_components(links)
    return rows.join(groups, "node", "left").select("segment_id", F.col("label").cast("int").alias("label"), F.coalesce("component", "node").alias("group_id"))
