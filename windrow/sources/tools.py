"""Result tables of prophage and virus finders in one form: (seq_id, label, pred, phage_score, other_score, method).

label is the digit after three underscores at the end of the id, null where there is none. Rows that a tool did not
process are left out. The contracts (column names, words, limits) are fixed values of those tools.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = ("seq_id", "label", "pred", "phage_score", "other_score", "method")


def _out(df: DataFrame, seq_id, pred, score, other, method: str) -> DataFrame:
    label = F.nullif(F.regexp_extract(seq_id, r"___([0-9])$", 1), F.lit("")).cast("int")
    rows = df.select(seq_id.alias("seq_id"), label.alias("label"), pred.cast("int").alias("pred"), score.alias("phage_score"), other.alias("other_score"), F.lit(method).alias("method"))
    return rows.filter("pred IS NOT NULL AND phage_score IS NOT NULL")


def _number(name: str):
    return F.col(f"`{name}`").try_cast("double")


def seeker(df: DataFrame) -> DataFrame:
    """Three columns by place: name, Phage or Bacteria, score."""
    name, call, score = (F.col(f"`{c}`") for c in df.columns[:3])
    s = score.try_cast("double")
    return _out(df, name, F.when(call == "Phage", 1).when(call == "Bacteria", 0), s, F.round(1 - s, 2), "Seeker")


def metaphinder(df: DataFrame) -> DataFrame:
    """The first column is the name; classification phage or negative; identity in percent."""
    rest = [c for c in df.columns if c not in ("merged coverage [%]", "number of hits", "size[bp]")]
    name, call, identity = (F.col(f"`{c}`") for c in rest[:3])
    s = identity.try_cast("double")
    return _out(df, name, F.when(call == "phage", 1).when(call == "negative", 0), s, F.round(100 - s, 3), "metaPhinder")


def genomad(df: DataFrame, viruses: DataFrame) -> DataFrame:
    """Scores of all sequences, and the table of those called viruses."""
    called = viruses.select("seq_name").distinct().withColumn("_virus", F.lit(1))
    rows = df.join(called, "seq_name", "left")
    other = F.round(_number("chromosome_score") + _number("plasmid_score"), 3)
    return _out(rows, F.col("seq_name"), F.coalesce("_virus", F.lit(0)), _number("virus_score"), other, "genomad")


def virsorter(df: DataFrame) -> DataFrame:
    """The name is cut at the first bar; the greater group is the call."""
    call = F.when(F.col("max_score_group") == "dsDNAphage", 1).when(F.col("max_score_group") == "ssDNA", 0)
    out = _out(df, F.split("seqname", r"\|")[0], call, _number("dsDNAphage"), _number("ssDNA"), "virsorter2")
    return out.filter("other_score IS NOT NULL")


def deepvirfinder(df: DataFrame, limit: float = 0.05) -> DataFrame:
    """Called where the p-value is under the limit."""
    s = _number("score")
    return _out(df, F.col("name"), F.when(_number("pvalue") < limit, 1).otherwise(0), F.round(s, 3), F.round(1 - s, 3), "deepVirFinder")


PARSERS = {"seeker": seeker, "metaphinder": metaphinder, "virsorter": virsorter, "deepvirfinder": deepvirfinder}
