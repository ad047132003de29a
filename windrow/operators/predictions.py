"""The table of predictions in one canonical form, whatever its columns are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Other names under which the columns are delivered.
ALIASES = {"predicted_label": "pred_label", "true_label": "label", "prob_class_1": "prob_1", "prob_class_0": "prob_0"}
_FALLBACK = {
    "segment_id": ("segment_id", "sequence_id", "id", "ID", "seq_ID"), "seq_id": ("seq_id", "contig_id"), "label": ("label", "in_prophage"),
    "start": ("start", "Start"), "end": ("end", "End"), "score": ("prob_1", "activation_value", "mean_activation"), "pred_label": ("pred_label",),
}


def first_column(df: DataFrame, names: tuple[str, ...], kind: str) -> Column:
    """The first of the named columns that df has (not the first that isn't null), or null."""
    here = {c.lower(): c for c in df.columns}
    found = next((here[n.lower()] for n in names if n.lower() in here), None)
    return F.col(f"`{found}`").try_cast(kind) if found else F.lit(None).cast(kind)


def normalize_predictions(df: DataFrame, threshold: float = 0.5, strict: bool = False) -> DataFrame:
    """(model, segment_id, seq_id, label, start, end, score, pred): fixed columns and types.

    score falls back over prob_1, activation_value and 0.5, NaN is null; pred is pred_label or else
    score >= threshold (> with strict); of several rows of a model and segment the one loaded last counts,
    repeated rows once; rows without a segment id are left out.
    """
    df = df.withColumnsRenamed({a: b for a, b in ALIASES.items() if a in df.columns and b not in df.columns})
    pick = {k: first_column(df, v, "string" if k in ("segment_id", "seq_id") else "double" if k == "score" else "bigint" if k in ("start", "end") else "double") for k, v in _FALLBACK.items()}
    if not any(c in df.columns for c in _FALLBACK["score"]):
        pick["score"] = F.lit(0.5)
    rows = df.select(
        first_column(df, ("model",), "string").alias("model"), pick["segment_id"].alias("segment_id"), F.nullif(F.upper(F.trim(pick["seq_id"])), F.lit("")).alias("seq_id"),
        pick["label"].cast("int").alias("label"), pick["start"].alias("start"), pick["end"].alias("end"), F.nanvl(pick["score"], F.lit(None).cast("double")).alias("score"),
        pick["pred_label"].cast("int").alias("pred_label"), first_column(df, ("loaded_at",), "timestamp").alias("loaded_at"),
    ).filter("segment_id IS NOT NULL")
    rest = ("label", "start", "end", "score", "pred_label", "seq_id")
    last = rows.groupBy("model", "segment_id").agg(F.max(F.struct("loaded_at", *rest)).alias("r")).select("model", "segment_id", *(f"r.{c}" for c in rest))
    above = (F.col("score") > threshold) if strict else (F.col("score") >= threshold)
    pred = F.coalesce("pred_label", above.cast("int"))
    return last.select("model", "segment_id", "seq_id", "label", "start", "end", "score", pred.alias("pred"))


def genome_of(column: str | Column) -> Column:
    """The assembly accession (with version) that an id begins with; null where there is none."""
    c = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.regexp_extract(c, r"(GC[AF]_[0-9]+\.[0-9]+)", 1), F.lit(""))


def mismatches(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per model: predictions whose label disagrees with score >= threshold."""
    off = F.col("pred") != (F.col("score") >= threshold).cast("int")
    return df.groupBy("model").agg(F.count("*").alias("rows"), F.count_if(off).alias("mismatches"), F.count_if(F.col("score").isNull()).alias("unscored"))
