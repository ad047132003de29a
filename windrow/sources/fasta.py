"""FASTA files to tables and back. Compressed files (.gz) are read as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windrow.functions.sequences import gc_content, reverse_complement, wrapped


def read_fasta(spark: SparkSession, paths: str | list[str], upper: bool = True, whole_header: bool = False) -> DataFrame:
    """(seq_id, description, sequence, source_file, position): one row per record.

    seq_id is the header's first token (the whole header with whole_header); blank lines are skipped; position orders the records
    of a file. A record begins with a > at the beginning of a line. Files are split by records, not lines, so a large file is read in parallel.
    """
    raw = spark.read.option("lineSep", "\n>").text(paths).select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_i"))
    raw = raw.withColumn("value", F.regexp_replace("value", r"^\s*>", ""))  # that of a file's first record
    raw = raw.filter(F.length(F.trim(F.translate("value", "\r\n\t", "   "))) > 0)
    header = F.trim(F.regexp_extract("value", r"^([^\r\n]*)", 1))
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", "")
    first = header if whole_header else F.regexp_extract(header, r"^(\S*)", 1)
    rest = F.regexp_extract(header, r"^\S*\s*(.*)$", 1)
    return raw.select(first.alias("seq_id"), rest.alias("description"), (F.upper(body) if upper else body).alias("sequence"), "source_file", F.struct("_block", "_i").alias("position"))


def last_per_id(records: DataFrame) -> DataFrame:
    """Of records with the same id the last one counts."""
    last = F.max_by(F.struct("description", "sequence", "source_file"), F.struct("source_file", "position"))
    return records.groupBy("seq_id").agg(last.alias("r")).select("seq_id", "r.*")


def both_strands(records: DataFrame) -> DataFrame:
    """Each record forward and reversed, with its orientation."""
    strands = F.array(F.struct(F.lit("forward").alias("orientation"), F.col("sequence").alias("s")), F.struct(F.lit("reverse").alias("orientation"), reverse_complement("sequence").alias("s")))
    return records.withColumn("_x", F.explode(strands)).drop("sequence").select("*", "_x.orientation", F.col("_x.s").alias("sequence")).drop("_x")


def longest_per_file(records: DataFrame) -> DataFrame:
    """The longest record of each file; the first of equals."""
    rest = [c for c in records.columns if c != "source_file"]
    first = Window.partitionBy("source_file").orderBy("position")
    numbered = records.select("source_file", *rest, F.row_number().over(first).alias("_n"))
    best = F.max_by(F.struct(*rest), F.struct(F.length("sequence"), -F.col("_n")))
    return numbered.groupBy("source_file").agg(best.alias("r")).select("source_file", "r.*")


def headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(contig_id, source_file): only the header lines are kept of the scan."""
    lines = spark.read.text(paths).filter(F.col("value").startswith(">"))
    return lines.select(F.regexp_extract("value", r"^>(\S*)", 1).alias("contig_id"), F.col("_metadata.file_path").alias("source_file"))


def genome_lengths(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(source_file, seq_id, contigs, length), seq_id that of the first header: sums over lines, no sequence is put together."""
    lines = spark.read.text(paths).select(F.trim("value").alias("v"), F.col("_metadata.file_path").alias("source_file"), F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("at"))
    head = F.col("v").startswith(">")
    first = F.min_by(F.when(head, F.regexp_extract("v", r"^>(\S*)", 1)), F.when(head, F.col("at"))).alias("seq_id")
    return lines.groupBy("source_file").agg(first, F.count_if(head).alias("contigs"), F.sum(F.when(head, 0).otherwise(F.length("v"))).alias("length"))


def first_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(source_file, seq_id, length, gc) of the first record of each file."""
    records = read_fasta(spark, paths)
    first = records.groupBy("source_file").agg(F.min_by(F.struct("seq_id", "sequence"), "position").alias("r"))
    return first.select("source_file", "r.seq_id", F.length("r.sequence").alias("length"), gc_content("r.sequence").alias("gc"))


def valid_alphabet(records: DataFrame) -> DataFrame:
    """records with valid: only A, C, G, T, N in either case."""
    return records.withColumn("valid", F.col("sequence").rlike("^[ACGTNacgtn]*$"))


def only_accessions(records: DataFrame, accessions: DataFrame, column: str = "accession") -> DataFrame:
    """Records whose id, cut at the first dot, is in the list."""
    wanted = accessions.select(F.substring_index(column, ".", 1).alias("_k")).distinct()
    return records.withColumn("_k", F.substring_index("seq_id", ".", 1)).join(wanted, "_k", "left_semi").drop("_k")


def fetch(intervals: DataFrame, records: DataFrame, length: int | None = None) -> DataFrame:
    """intervals(seq_id, start, end) with their bases. With length, an interval is widened about its middle to that length and shifted into the sequence."""
    j = intervals.join(records.select("seq_id", F.col("sequence").alias("_s")), "seq_id")
    size = F.length("_s")
    if length is not None:
        start = F.floor((F.col("start") + F.col("end") - length) / F.lit(2))
        start = F.greatest(F.lit(0), F.least(start, size - length))
        j = j.withColumn("start", start).withColumn("end", F.least(F.col("start") + length, size))
    a, b = F.greatest(F.lit(0), "start"), F.least("end", size)
    return j.withColumn("sequence", F.substring(F.col("_s"), (a + 1).cast("int"), F.greatest(F.lit(0), b - a).cast("int"))).drop("_s")


def write_fasta(df: DataFrame, path: str, id_col: str = "seq_id", sequence_col: str = "sequence", width: int = 80, mode: str = "error", description_col: str | None = None) -> None:
    """Records as FASTA text with lines of width letters; the description, if any, follows the id."""
    more = F.concat(F.lit(" "), F.col(description_col)) if description_col else F.lit("")
    df.select(F.concat(F.lit(">"), F.col(id_col), F.coalesce(more, F.lit("")), F.lit("\n"), wrapped(sequence_col, width)).alias("value")).write.mode(mode).text(path)


#: Records whose sizes are in one array of chunk_numbers.
SPAN = 4096


def chunk_numbers(df: DataFrame, order: str, cap: int, id_col: str = "seq_id", sequence_col: str = "sequence") -> DataFrame:
    """df with chunk: records in order, a new chunk where the running size would pass the cap.

    The greedy rule is a recurrence over all records. Records are placed in order by ranges, SPAN of them are one row of sizes, and
    only these rows pass one after the other through a task that streams and holds one of them at a time; sequences stay where they are.
    """
    import numpy as np
    import pandas as pd

    from windrow.operators.selection import placed
    from windrow.ship import ship

    def run(batches):
        chunk, filled = 0, 0
        for pdf in batches:
            for sizes, span in zip(pdf["sizes"], pdf["span"], strict=True):
                out, upto, i = np.empty(len(sizes), np.int64), np.cumsum(sizes), 0
                while i < len(sizes):
                    before = upto[i - 1] if i else 0
                    j = max(int(np.searchsorted(upto, before + cap - filled, side="right")), i + (not filled))
                    out[i:j] = chunk
                    filled = filled + int((upto[j - 1] if j else 0) - before)
                    if j < len(sizes):
                        chunk, filled = chunk + 1, 0
                    i = j
                yield pd.DataFrame({"span": span, "chunk": [out.tolist()]})

    ship(df.sparkSession)
    size = (F.length(sequence_col) + F.length(id_col) + 3).cast("bigint")
    # copies of a row of sizes are alike, so the place is enough to find them again
    keys = placed(df.select(F.col(id_col).alias("_k"), F.col(order).cast("string").alias("_o"), size.alias("_n")), ["_o", "_k"]).withColumn("span", F.floor(F.col("place") / F.lit(SPAN)))
    spans = keys.groupBy("span").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "_n"))), lambda x: x["_n"]).alias("sizes"))  # SPAN numbers a row
    numbered = spans.coalesce(1).sortWithinPartitions("span").mapInPandas(run, "span bigint, chunk array<bigint>").select("span", F.posexplode("chunk").alias("_i", "chunk"))
    chunks = keys.withColumn("_i", (F.col("place") - F.col("span") * SPAN).cast("int")).join(numbered, ["span", "_i"]).select(F.col("_k").alias(id_col), F.col("chunk").cast("int").alias("chunk"))
    return df.join(chunks, id_col)
