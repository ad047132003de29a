"""Whole ways through the data: sequences to windows to scores to regions, and segments to clean, split, merged sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windrow.functions import sequences as sq
from windrow.operators import sampling as sm
from windrow.operators.metrics import confusion_by
from windrow.operators.predictions import normalize_predictions
from windrow.operators.signal import collapse, regions, smooth
from windrow.ship import ship

#: A scorer reads batches with segment_id and sequence and returns segment_id, prob_0 and prob_1.
Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def segment(records: DataFrame, assembly: str, window: int, stride: int, least: int = 500) -> DataFrame:
    """records(assembly, seq_id, sequence) in windows, numbered per assembly: (segment_id, assembly, seq_id, start, end, sequence).

    The windows are laid out by an array expression; numbers come from the contigs' window counts, so sequences aren't sorted.
    """
    cut = records.withColumn("_w", sq.sliding_windows(F.length("sequence"), window, stride, least))
    counts = cut.select(assembly, "seq_id", F.size("_w").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(assembly).orderBy("seq_id").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(assembly, "seq_id", F.coalesce(before, F.lit(0)).alias("_before"))
    rows = cut.join(counts, [assembly, "seq_id"]).select(assembly, "seq_id", "sequence", "_before", F.posexplode("_w").alias("_i", "w"))
    part = F.substring(F.col("sequence"), (F.col("w.start") + 1).cast("int"), (F.col("w.end") - F.col("w.start")).cast("int"))
    name = F.concat(F.col(assembly), F.lit("_seg_"), F.format_string("%05d", F.col("_before") + F.col("_i") + 1))
    return rows.select(name.alias("segment_id"), assembly, "seq_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), part.alias("sequence"))


def gc_scorer(centre: float = 0.5, slope: float = 20.0) -> Scorer:
    """A stand-in for a model: the logistic of the GC share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for pdf in batches:
            s = pdf["sequence"].fillna("").str.upper()
            n = s.str.len().clip(lower=1)
            p = 1 / (1 + np.exp(-slope * ((s.str.count("G") + s.str.count("C")) / n - centre)))
            yield pd.DataFrame({"segment_id": pdf["segment_id"], "prob_0": 1 - p, "prob_1": p})

    return run


def score(segments: DataFrame, scorer: Scorer, model: str) -> DataFrame:
    """segments with the scores of a model, loaded once per task by its scorer; sequences end here."""
    ship(segments.sparkSession)
    scored = segments.select("segment_id", "sequence").mapInPandas(scorer, "segment_id string, prob_0 double, prob_1 double")
    return segments.drop("sequence").join(scored, "segment_id").withColumn("model", F.lit(model))


def call_regions(scored: DataFrame, span: int = 5, threshold: float = 0.5, gap: int = 3000, smallest: int = 5000, step: int = 1000) -> DataFrame:
    """Windows to bins, smoothed in both directions, thresholded, joined and filtered: (model, seq_id, start, end, size, windows, avg_score)."""
    rows = normalize_predictions(scored)
    bins = collapse(rows, ["model", "seq_id"], step).select("model", "seq_id", "start", "end", "score")
    smoothed = smooth(bins, ["model", "seq_id"], "start", "score", span)
    return regions(smoothed.filter(F.col("smooth") >= threshold), ["model", "seq_id"], gap, smallest)


def genome_wide(records: DataFrame, assembly: str, scorers: dict[str, Scorer], window: int = 2000, stride: int = 1000, **calling) -> DataFrame:
    """Sequences to called regions of every model; calling goes to call_regions."""
    cut = segment(records, assembly, window, stride)
    out = None
    for name, scorer in scorers.items():
        part = call_regions(score(cut, scorer, name), **calling)
        out = part if out is None else out.unionByName(part)
    return out


def merged_set(positive: DataFrame, negative: DataFrame, contaminated: DataFrame, seed: int) -> DataFrame:
    """(segment_id, sequence, label, source) of both classes without contaminated genomes, in random order."""
    clean = negative.join(contaminated.select("accession").distinct(), "accession", "left_anti")
    both = positive.select("segment_id", "sequence", F.lit(1).alias("label"), F.lit("inphared").alias("source")).unionByName(clean.select("segment_id", "sequence", F.lit(0).alias("label"), F.lit("gtdb").alias("source")))
    return sm.shuffled(both, "segment_id", seed)


def evaluate(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and rates of scored segments with labels."""
    return confusion_by(normalize_predictions(scored), keys)
