"""Intervals: continuous periods and gaps, islands, overlap joins and base-level agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Coordinates per block when periods are merged within blocks first, so that a hot key is spread.
BLOCK = 1 << 20


def _sessions(df: DataFrame, keys: list[str]) -> DataFrame:
    """One merge of overlapping (_s, _e) per keys with session windows whose length each row brings itself."""
    at = F.timestamp_micros(F.col("_s"))
    length = F.concat((F.col("_e") - F.col("_s")).cast("string"), F.lit(" microseconds"))
    merged = df.withColumn("_at", at).groupBy(*keys, F.session_window("_at", length).alias("_w")).agg(F.lit(1).alias("_n"))
    return merged.select(*keys, F.unix_micros("_w.start").alias("_s"), F.unix_micros("_w.end").alias("_e"))


def continuous_periods(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", block: int = BLOCK) -> DataFrame:
    """(keys, start, end): the longest pieces covered by the intervals of each key, which overlap or meet.

    An interval runs from the smaller to the larger coordinate, half-open. Rows with a null key or
    coordinate or of no extent are left out. Coordinates serve as microseconds of a session window; windows
    merge within blocks of coordinates first (which spreads a hot key and pre-aggregates), then per key.
    Periods that only touch are joined afterwards.
    """
    s, e = F.col(start).cast("bigint"), F.col(end).cast("bigint")
    rows = df.select(*keys, F.least(s, e).alias("_s"), F.greatest(s, e).alias("_e"), *[F.col(c).isNull().alias(f"_null_{i}") for i, c in enumerate([*keys, start, end])])
    for i in range(len(keys) + 2):
        rows = rows.filter(~F.col(f"_null_{i}"))
    rows = rows.filter("_s < _e").groupBy(*keys, "_s").agg(F.max("_e").alias("_e"))
    rows = _sessions(rows.withColumn("_block", F.floor(F.col("_s") / F.lit(block))), [*keys, "_block"])
    rows = _sessions(rows.drop("_block"), keys)
    ordered = Window.partitionBy(*keys).orderBy("_s")
    rows = rows.withColumn("_new", (F.col("_s") > F.lag("_e").over(ordered)).cast("int"))
    rows = rows.withColumn("_piece", F.sum(F.coalesce("_new", F.lit(1))).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_piece").agg(F.min("_s").alias("start"), F.max("_e").alias("end")).drop("_piece")


def periods_and_gaps(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", block: int = BLOCK) -> DataFrame:
    """(kind, keys, start, end): the periods of continuous_periods and, of kind gap, the room between neighbours."""
    periods = continuous_periods(df, keys, start, end, block)
    following = F.lead("start").over(Window.partitionBy(*keys).orderBy("start"))
    both = periods.withColumn("_next", following).select(
        *keys,
        F.explode(F.array(
            F.struct(F.lit("period").alias("kind"), F.col("start").alias("start"), F.col("end").alias("end")),
            F.struct(F.lit("gap").alias("kind"), F.col("end").alias("start"), F.col("_next").alias("end")),
        )).alias("_x"),
    )
    return both.select("_x.kind", *keys, "_x.start", "_x.end").filter("end IS NOT NULL")


def accession_number(column: str | Column) -> Column:
    """The run of exactly nine digits in an assembly's name, as a string; null where there is none."""
    c = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.regexp_extract(c, r"(?<![0-9])([0-9]{9})(?![0-9])", 1), F.lit(""))


def contig_name(column: str | Column) -> Column:
    """A contig's name trimmed and in upper case; null where nothing is left."""
    c = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.upper(F.regexp_replace(c, r"^\s+|\s+$", "")), F.lit(""))


def prophage_periods(known: DataFrame) -> DataFrame:
    """(kind, accession_no, ncbi_id, start, end) of a table of known prophages.

    Rows missing assembly, contig or a coordinate, without an accession number, or of no extent are left
    out; repeated and late rows change nothing; an empty table gives an empty result.
    """
    rows = known.select(accession_number("assembly").alias("accession_no"), contig_name("ncbi_id").alias("ncbi_id"), "start", "end")
    return periods_and_gaps(rows, ["accession_no", "ncbi_id"])


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], least: int = 1, bucket: int = 10_000) -> DataFrame:
    """Pairs of intervals of one key that overlap by at least least bases: (keys, l_start, l_end, r_start, r_end, overlap) and all columns of both, prefixed.

    Each interval is set out into the buckets it touches and joined by key and bucket; a pair is kept only in the bucket
    of its later start, so it comes once. A hot key is spread over its buckets.
    """
    if least < 1:
        raise ValueError("intervals that don't overlap are no pairs")

    def out(df: DataFrame, p: str) -> DataFrame:
        rows = df.filter("start IS NOT NULL AND end IS NOT NULL AND start < end")
        rows = rows.select(*keys, *(F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in keys))
        return rows.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(f"{p}_start") / F.lit(bucket)), F.floor((F.col(f"{p}_end") - 1) / F.lit(bucket)))))

    pairs = out(left, "l").join(out(right, "r"), [*keys, "_bucket"])
    later = F.greatest("l_start", "r_start")
    size = F.least("l_end", "r_end") - later
    return pairs.filter(F.floor(later / F.lit(bucket)) == F.col("_bucket")).withColumn("overlap", size).filter(F.col("overlap") >= least).drop("_bucket")


def base_confusion(truth: DataFrame, called: DataFrame, lengths: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn, tn in bases per key from interval tables and lengths(keys, length), by interval algebra.

    Each side is merged first; intervals are clipped to the length; a key without intervals is all true negative.
    """

    def clipped(df: DataFrame) -> DataFrame:
        rows = df.join(lengths, keys).withColumn("start", F.greatest(F.lit(0), "start")).withColumn("end", F.least("end", "length"))
        return continuous_periods(rows.filter("start < end").select(*keys, "start", "end"), keys)

    t, c = clipped(truth), clipped(called)
    size = F.sum(F.col("end") - F.col("start"))
    both = overlap_join(t, c, keys).groupBy(*keys).agg(F.sum("overlap").alias("tp"))
    out = lengths.join(t.groupBy(*keys).agg(size.alias("_t")), keys, "left").join(c.groupBy(*keys).agg(size.alias("_c")), keys, "left").join(both, keys, "left").fillna(0, ["_t", "_c", "tp"])
    fp, fn = F.col("_c") - F.col("tp"), F.col("_t") - F.col("tp")
    return out.select(*keys, "tp", (F.col("length") - F.col("tp") - fp - fn).alias("tn"), fp.alias("fp"), fn.alias("fn"))
