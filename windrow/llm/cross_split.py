"""Problem 1: records of evaluation splits that are also, wholly or nearly, in the training split.

Minwise hashing with banded buckets: 72 orders of the stretches, the least stretch under each, a
band per value. What counts is the share of the smaller record's stretches that the larger one has
(0.6), and between records of different size that means a low Jaccard similarity, so a band has
one value, and a candidate must share two bands (one of 2,556 bands of two values), and more where the sizes of a pair
make more likely. A pair with a Jaccard similarity of 0.136 (0.6 at sizes 1 : 4) is missed with probability 4e-4,
one of 0.185 with 7e-6. Pairs of sizes 1 : 4 and beyond are also looked up by stretches (``contained.py``), whose
loss is 1e-4 whatever the ratio. Only pairs of a training and an evaluation record are kept, and they are checked exactly
on all their distinct stretches.

Defined cases: rows with a null id are left out; repeated rows count once; labels and sources that are
null stay null; sequences without a stretch are in no pair; empty tables give empty results
(the report then has no rows); further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm import minwise
from windrow.llm.contained import contained_candidates
from windrow.llm.stretches import multipliers
from windrow.llm.tables import tidy

ORDERS, LEAST_HITS = 72, 2
#: Sizes of which one is so many times the other are also looked up by stretches.
UNLIKE_SIZES = 4.0


def _side(df: DataFrame, split: int, columns: dict[str, str]) -> DataFrame:
    return df.select(
        F.col(columns["id"]).cast("string").alias("id"), F.lit(split).alias("side"), F.col(columns["label"]).cast("int").alias("label"),
        tidy(columns["source"]).alias("source"), F.col(columns["sequence"]).alias("sequence"),
    ).filter("id IS NOT NULL")


COLUMNS = {"id": "segment_id", "label": "label", "source": "source", "sequence": "sequence"}


def cross_split_pairs(train: DataFrame, evaluation: dict[str, DataFrame], threshold: float = 0.6, columns: dict[str, str] = COLUMNS) -> DataFrame:
    """One row per pair of a training and an evaluation record that overlap.

    (train_id, eval_id, split, train_label, eval_label, train_source, eval_source, containment, similarity):
    containment is the share of the smaller record's distinct stretches that are common.
    """
    splits = list(evaluation)
    both = _side(train, 0, columns)
    for i, name in enumerate(splits):
        both = both.unionByName(_side(evaluation[name], i + 1, columns))
    feats = minwise.features(both, multipliers(ORDERS), both_ends=False, name="minwise")
    sided = feats.withColumn("side", F.least("side", F.lit(1)))
    pairs = minwise.candidates(sided, minwise.Search(ORDERS, 1, threshold, of_smaller=True, cross=True, least_hits=LEAST_HITS, ratio=UNLIKE_SIZES))
    unlike = contained_candidates(sided, threshold, UNLIKE_SIZES)
    if unlike is not None:
        pairs = pairs.unionByName(unlike).distinct()
    checked = minwise.verified(pairs, feats)
    links = checked.filter(F.col("common") >= F.lit(threshold) * F.least("size_a", "size_b"))
    links = links.select(
        "a", "b", (F.col("common") / F.least("size_a", "size_b")).alias("containment"),
        (F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common"))).alias("similarity"),
    )
    members = feats.filter("tid IS NOT NULL").select("id", "side", "label", "source", "tid")
    members = members.groupBy("id", "side", "tid").agg(F.max(F.struct("label", "source")).alias("at"))
    mine = members.filter("side = 0").select(F.col("tid").alias("a"), F.col("id").alias("train_id"), F.col("at.label").alias("train_label"), F.col("at.source").alias("train_source"))
    others = members.filter("side > 0").select(
        F.col("tid").alias("b"), F.col("id").alias("eval_id"), F.element_at(F.array(*map(F.lit, splits)), F.col("side")).alias("split"),
        F.col("at.label").alias("eval_label"), F.col("at.source").alias("eval_source"),
    )
    # copies: a text that is on both sides
    same = mine.select("a").distinct().join(others.select(F.col("b").alias("a")).distinct(), "a")
    same = same.select("a", F.col("a").alias("b"), F.lit(1.0).alias("containment"), F.lit(1.0).alias("similarity"))
    out = links.unionByName(same).join(mine, "a").join(others, "b")
    keys = ("train_id", "eval_id", "split")
    rest = ("train_label", "eval_label", "train_source", "eval_source", "containment", "similarity")
    best = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("containment", "similarity")).alias("best"))
    return best.select(*keys, *(F.col(f"best.{c}").alias(c) for c in rest))


def cross_split_report(pairs: DataFrame) -> DataFrame:
    """Counts of confirmed pairs per evaluation split and source of the evaluation record.

    Labels that are null on either side are neither agreeing nor conflicting.
    """
    agree = F.col("train_label") == F.col("eval_label")
    return pairs.groupBy("split", F.col("eval_source").alias("source")).agg(
        F.count("*").alias("pairs"), F.count_if(agree).alias("agreeing"), F.count_if(~agree).alias("conflicting"),
        F.countDistinct("eval_id").alias("eval_records"), F.count_if(F.col("similarity") == 1.0).alias("identical"),
    )
