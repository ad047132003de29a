"""Queries that show what the operators promise: one row of counts and truths each, with the row that must come out as SQL.

Pieces, splits, samples, packings and mixes are not unique, so no SQL gives their rows; it gives what holds for all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windrow.llm.group_split import SHARES, group_split, split_report
from windrow.llm.mixing import mix_sources
from windrow.llm.packing import CAPACITY, pack, packing_report
from windrow.llm.pieces import LIMIT, OVERLAP, split_oversized
from windrow.llm.related import segment_groups
from windrow.llm.sampling import quota_sample
from windrow.llm.tables import read, tidy
from windrow.llm.tokens import VOCABULARY, token_sizes

#: Containers that a packing may use beyond one in so many of the least that could hold the tokens, and most that a split's share may be off beside the heaviest group.
MOST_MORE, MOST_OFF = 0.02, 0.05


def p3_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Pieces cover every record from its first base to its last, keep to the limit, and share OVERLAP bases after a forced cut and none after a gap."""
    pieces = split_oversized(read(spark, d, "segments"))
    order = Window.partitionBy("segment_id").orderBy("piece")
    pieces = pieces.withColumn("next", F.lead("from_base").over(order)).withColumn("before", F.lag("to_base").over(order))
    after = F.col("to_base") - F.col("next")
    joint = F.when(F.col("next").isNull(), F.col("piece") == F.col("pieces")).when(F.col("cut") == "forced", after == OVERLAP).otherwise(after == 0)
    return pieces.agg(
        F.countDistinct("segment_id").alias("records"), F.bool_and((F.col("from_base") == 0) == (F.col("piece") == 1)).alias("from_first"), F.bool_and(joint).alias("joined"),
        F.bool_and(F.col("to_base") - F.col("from_base") <= LIMIT).alias("within_limit"), F.bool_and(F.length("sequence") == F.col("to_base") - F.col("from_base")).alias("whole_text"),
        F.bool_and((F.col("cut") == "end") == (F.col("piece") == F.col("pieces"))).alias("to_last"), F.countDistinct("segment_id", "piece").alias("pieces") == F.count("*"),
    ).select("records", "from_first", "joined", "within_limit", "whole_text", "to_last")


def p5_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Every labelled record has one split, no group has two, and each label's shares are near the targets: off by MOST_OFF and the share of the heaviest group at most."""
    split = group_split(segment_groups(read(spark, d, "segments"), read(spark, d, "known_prophages"), read(spark, d, "contig_map")))
    of_group = split.groupBy("group_id").agg(F.countDistinct("split").alias("n")).agg(F.max("n").alias("most"))
    heaviest = split.groupBy("label", "group_id").agg(F.count("*").alias("n")).groupBy("label").agg((F.max("n") / F.sum("n")).alias("heaviest"))
    off = split_report(split).join(heaviest, "label").agg(F.max(F.abs(F.col("share") - F.col("target_share")) - F.col("heaviest")).alias("off"))
    records = split.agg(F.countDistinct("segment_id").alias("records"), (F.count("*") == F.countDistinct("segment_id")).alias("once"), F.bool_and(F.col("split").isin(*SHARES)).alias("named"))
    return records.crossJoin(of_group).crossJoin(off).select("records", "once", "named", (F.col("most") == 1).alias("groups_whole"), (F.col("off") <= MOST_OFF).alias("near_targets"))  # three rows of one each


def p6_categories(spark: SparkSession, d: str) -> DataFrame:
    """The report without the sample: what the pool has of each category, what is wanted, and whether it falls short."""
    _, report = quota_sample(read(spark, d, "train"), read(spark, d, "label_targets"))
    return report.select("label", "source", "target_share", "min_rows", "pool_rows", F.round("wanted", 6).alias("wanted"), "short")


def p6_invariants(spark: SparkSession, d: str) -> DataFrame:
    """The sample has exactly the quota of every category, each record once, and no more than the size asked for; unmet categories are taken whole."""
    sample, report = quota_sample(read(spark, d, "train"), read(spark, d, "label_targets"))
    once = sample.agg((F.count("*") == F.countDistinct("segment_id")).alias("once"), F.count("*").alias("rows"))
    kept = report.agg(
        F.count("*").alias("categories"), F.bool_and(F.col("sampled") == F.col("quota")).alias("quotas_met"), F.bool_and(F.col("quota") <= F.col("pool_rows")).alias("within_pool"),
        F.bool_and(~F.col("short") | (F.col("quota") == F.col("pool_rows"))).alias("short_whole"), F.bool_and((F.col("quota") >= F.least("min_rows", "pool_rows"))).alias("minima"), F.sum("quota").alias("n"),
    )
    return once.crossJoin(kept).select("categories", "once", "quotas_met", "within_pool", "short_whole", "minima", (F.col("rows") == F.col("n")).alias("complete"))  # one row each


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Every text is placed once from its first token to its last, divided only beyond the capacity, and no container is overfull."""
    packed = pack(read(spark, d, "documents"))
    order = Window.partitionBy("doc_id").orderBy("piece")
    ends = packed.withColumn("before", F.coalesce(F.lag("token_to").over(order), F.lit(0)))
    size = F.col("token_to") - F.col("token_from")
    texts = ends.agg(
        F.countDistinct("doc_id").alias("texts"), F.bool_and(F.col("token_from") == F.col("before")).alias("joined"),
        F.bool_and((F.col("piece") == F.col("pieces")) | (size == CAPACITY)).alias("cut_when_full"), F.bool_and((size > 0) == F.col("container").isNotNull()).alias("placed"),
    )
    report = packing_report(packed).select((F.col("fullest") <= CAPACITY).alias("within_capacity"), (F.col("containers") <= F.ceil(F.col("tokens") / CAPACITY) * (1 + MOST_MORE) + 1).alias("filled"))
    return texts.crossJoin(report)  # one row each


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """No text is used more often than allowed; sources that can reach their weight do so to within their longest text, the others are used whole."""
    _, report = mix_sources(read(spark, d, "documents"), read(spark, d, "mix_targets"))
    longest = token_sizes(read(spark, d, "documents"), "doc_id", "text", "source", VOCABULARY).groupBy(tidy("source").alias("source")).agg(F.max("tokens").alias("longest"))
    report = report.withColumn("key", F.lower(F.trim("source"))).join(longest.withColumnRenamed("source", "key"), "key", "left")
    off = F.abs(F.col("mixed_tokens") - F.col("target_tokens"))
    return report.agg(
        F.count("*").alias("sources"), F.bool_and(F.col("most_copies") <= F.col("max_repeats")).alias("within_caps"),
        F.bool_and(F.col("short") | (off <= F.col("longest"))).alias("near_targets"), F.bool_and(~F.col("short") | (F.col("mixed_tokens") == F.col("max_repeats") * F.col("source_tokens"))).alias("short_whole"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p3_invariants, p5_invariants, p6_categories, p6_invariants, p7_invariants, p8_invariants)}


_POOL = """
p AS (SELECT latest.label AS label, latest.source AS source FROM (SELECT segment_id, max(struct_pack(label := label, source := lower(trim(source)))) AS latest FROM train WHERE segment_id IS NOT NULL AND label IS NOT NULL AND trim(source) <> '' GROUP BY segment_id)),
c AS (SELECT label, source, count(*) AS n FROM p GROUP BY label, source), s AS (SELECT floor(count(*) * 0.25) AS size FROM p),
t AS (SELECT CAST(label AS INT) AS label, lower(trim(source)) AS source, max(target_share) AS target_share, max(coalesce(min_rows, 0)) AS min_rows FROM label_targets WHERE label IS NOT NULL AND trim(source) <> '' AND target_share IS NOT NULL GROUP BY 1, 2)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_invariants": "SELECT count(DISTINCT segment_id) AS records, TRUE AS from_first, TRUE AS joined, TRUE AS within_limit, TRUE AS whole_text, TRUE AS to_last FROM segments WHERE length(regexp_replace(sequence, '[^A-Za-z]', '', 'g')) > 8000",
        "p5_invariants": "SELECT count(DISTINCT segment_id) AS records, TRUE AS once, TRUE AS named, TRUE AS groups_whole, TRUE AS near_targets FROM segments WHERE segment_id IS NOT NULL AND label IS NOT NULL",
        "p6_categories": f"WITH {_POOL} SELECT t.label, t.source, t.target_share, CAST(t.min_rows AS BIGINT) AS min_rows, coalesce(c.n, 0) AS pool_rows, round(greatest(t.min_rows, t.target_share * s.size), 6) AS wanted, coalesce(c.n, 0) < greatest(t.min_rows, t.target_share * s.size) AS short FROM t LEFT JOIN c USING (label, source), s",
        "p6_invariants": f"WITH {_POOL} SELECT count(*) AS categories, TRUE AS once, TRUE AS quotas_met, TRUE AS within_pool, TRUE AS short_whole, TRUE AS minima, TRUE AS complete FROM t",
        "p7_invariants": "SELECT count(DISTINCT doc_id) AS texts, TRUE AS joined, TRUE AS cut_when_full, TRUE AS placed, TRUE AS within_capacity, TRUE AS filled FROM documents",
        "p8_invariants": "SELECT count(DISTINCT lower(trim(source))) AS sources, TRUE AS within_caps, TRUE AS near_targets, TRUE AS short_whole FROM mix_targets WHERE trim(source) <> '' AND weight IS NOT NULL",
    }
