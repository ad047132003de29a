"""Problem 4: records whose sequences differ by small changes or rearrangement, in groups.

Min-max hashing: each of 32 orders of the stretches gives a record two signature values, the least
and the greatest stretch, so 32 hash evaluations fill a signature of 64; two values make a band.
A pair with a Jaccard similarity of one half shares none of the 32 bands with probability 1e-4.
Candidates are checked exactly on the distinct stretches of their whole sequences.

Defined cases: rows with a null id are left out; repeated rows of an id count once, and if rows of
one id differ each version may link it; sequences that are null, empty or without a stretch are
in no pair and form groups of one; an empty table gives empty results; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm import minwise
from windrow.llm.stretches import multipliers
from windrow.operators.graph import connected_components
from windrow.storage import materialize

ORDERS, PER_BAND = 32, 2


def _features(df: DataFrame, id_col: str, sequence_col: str) -> DataFrame:
    records = df.select(
        F.col(id_col).cast("string").alias("id"), F.lit(0).alias("side"), F.lit(None).cast("int").alias("label"),
        F.lit(None).cast("string").alias("source"), F.col(sequence_col).alias("sequence"),
    ).filter("id IS NOT NULL")
    return minwise.features(records, multipliers(ORDERS), both_ends=True, name="minmax")


def _text_links(feats: DataFrame, threshold: float) -> DataFrame:
    pairs = minwise.candidates(feats, minwise.Search(2 * ORDERS, PER_BAND, threshold, of_smaller=False, cross=False))
    checked = minwise.verified(pairs, feats)
    links = checked.withColumn("union", F.col("size_a") + F.col("size_b") - F.col("common"))
    links = links.filter(F.col("common") >= F.lit(threshold) * F.col("union"))
    return links.select("a", "b", (F.col("common") / F.col("union")).alias("similarity"))


def near_duplicate_pairs(df: DataFrame, id_col: str = "segment_id", sequence_col: str = "sequence", threshold: float = 0.5) -> DataFrame:
    """(segment_id_a, segment_id_b, similarity) for every pair of records at or above the threshold, the smaller id first."""
    feats = _features(df, id_col, sequence_col)
    members = feats.filter("tid IS NOT NULL").select("id", "tid").distinct()
    links = _text_links(feats, threshold)
    a, b = (members.select(F.col("id").alias(f"id_{x}"), F.col("tid").alias(x)) for x in "ab")
    across = links.join(a, "a").join(b, "b").select("id_a", "id_b", "similarity")
    copies = members.groupBy("tid").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("tid").alias("a"))
    same = a.join(copies, "a", "left_semi")
    same = same.join(same.select(F.col("a"), F.col("id_a").alias("id_b")), "a").filter("id_a < id_b").select("id_a", "id_b", F.lit(1.0).alias("similarity"))
    pairs = across.unionByName(same).filter("id_a <> id_b")
    pairs = pairs.select(F.least("id_a", "id_b").alias("segment_id_a"), F.greatest("id_a", "id_b").alias("segment_id_b"), "similarity")
    return pairs.groupBy("segment_id_a", "segment_id_b").agg(F.max("similarity").alias("similarity"))


def near_duplicate_groups(df: DataFrame, id_col: str = "segment_id", sequence_col: str = "sequence", threshold: float = 0.5) -> DataFrame:
    """(segment_id, group_id, group_size, links) for every record: its group and how many texts its own is linked to.

    group_id is the least id of the group. Copies of a text aren't expanded into pairs.
    """
    feats = _features(df, id_col, sequence_col)
    members = feats.select("id", "tid").distinct()
    links = materialize(_text_links(feats, threshold).select("a", "b"), "links")
    degree = links.select(F.explode(F.array("a", "b")).alias("tid")).groupBy("tid").agg(F.count("*").alias("links"))
    groups = connected_components(links, "a", "b").select(F.col("node").alias("tid"), "component")
    placed = members.join(groups, "tid", "left").join(degree, "tid", "left")
    # a record without a stretch stands for itself; an id with several versions joins their groups
    placed = placed.withColumn("key", F.coalesce(F.col("component"), F.col("tid")).cast("string"))
    placed = placed.withColumn("key", F.coalesce(F.concat(F.lit("t"), "key"), F.concat(F.lit("i"), "id")))
    placed = materialize(placed.groupBy("id", "key").agg(F.max("links").alias("links")), "placed")
    several = placed.groupBy("id").agg(F.count("*").alias("n"), F.min("key").alias("least")).filter("n > 1")
    joined = connected_components(placed.join(several, "id").select("key", "least"), "key", "least")
    placed = placed.join(joined.withColumnRenamed("node", "key"), "key", "left").withColumn("key", F.coalesce("component", "key"))
    placed = placed.groupBy("id", "key").agg(F.max("links").alias("links"))
    heads = placed.groupBy("key").agg(F.min("id").alias("group_id"), F.count("*").alias("group_size"))
    out = placed.join(heads, "key")
    return out.select(F.col("id").alias("segment_id"), "group_id", "group_size", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
