"""Delimited and nested text sources with fixed schemas, bad rows kept apart, and sinks of the same kinds."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLAST_STANDARD = "qseqid string, sseqid string, pident double, length int, mismatch int, gapopen int, qstart bigint, qend bigint, sstart bigint, send bigint, evalue double, bitscore double"
BLAST_FRAGMENTS = "qseqid string, sseqid string, pident double, length int, qlen int, slen int, qcovs double, evalue double, bitscore double"
GFF = "seqid string, source string, type string, start bigint, end bigint, score string, strand string, phase string, attributes string"
BED = "seq_id string, start bigint, end bigint, name string"
MASH = "query string, reference string, distance double, p_value double, shared string"
METRIC_WORDS = ("summary", "aggregate", "combined", "total")


def read_delimited(spark: SparkSession, path: str | list[str], schema: str, sep: str = "\t", header: bool = False, comment: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Good rows of the schema, and bad ones as (line, message, source_file): rows with too few columns or numbers that can't be read.

    Everything is read as text once and cast with try_cast, so a bad cell costs its row only; an empty file gives no rows.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source_file")).filter(F.length(F.trim("value")) > 0)
    if comment:
        lines = lines.filter(~F.col("value").startswith(comment))
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    if header:
        lines = lines.filter(F.split("value", sep)[0] != fields[0][0])
    cells = F.split("value", sep, -1)
    typed = lines.select("source_file", F.col("value").alias("line"), F.size(cells).alias("_n"), *(F.nullif(F.get(cells, F.lit(i)), F.lit("")).alias(f"_t{i}") for i in range(len(fields))))
    typed = typed.select("source_file", "line", "_n", *(F.col(f"_t{i}").try_cast(t).alias(n) for i, (n, t) in enumerate(fields)), *(f"_t{i}" for i in range(len(fields))))
    wrong = [F.when(F.col("_n") < len(fields), F.concat(F.lit(f"expected {len(fields)} columns, found "), F.col("_n").cast("string")))]
    wrong += [F.when(F.col(f"_t{i}").isNotNull() & F.col(n).isNull(), F.concat(F.lit(f"{n} is no {t}: "), F.col(f"_t{i}"))) for i, (n, t) in enumerate(fields) if t != "string"]
    message = F.coalesce(*wrong)
    return typed.filter(message.isNull()).select(*(n for n, _ in fields)), typed.filter(message.isNotNull()).select("line", message.alias("message"), "source_file")


def read_csv(spark: SparkSession, path: str | list[str], schema: str, sep: str = ",") -> DataFrame:
    """CSV with a header, quoted cells of any length, and a fixed schema."""
    return spark.read.csv(path, schema=schema, header=True, sep=sep, multiLine=True, escape='"', maxCharsPerColumn=-1)


def read_gff(spark: SparkSession, path: str | list[str], kind: str = "CDS") -> DataFrame:
    """Features of a kind with id, product, gene, note and locus_tag from the attributes (either spelling)."""
    rows, _ = read_delimited(spark, path, GFF, comment="#")
    a = F.str_to_map("attributes", F.lit(";"), F.lit("="))
    get = lambda *names: F.coalesce(*(a[n] for n in names))
    rows = rows.filter(F.col("type") == kind)
    return rows.select("seqid", "start", "end", "strand", get("ID", "id").alias("id"), get("product", "Product").alias("product"), get("Name", "gene").alias("gene"), get("note", "Note").alias("note"), get("locus_tag").alias("locus_tag"))


def read_bakta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Coding features of annotation JSON: (locus, product, cog_category, cog_id, source_file)."""
    schema = "features array<struct<type:string,locus:string,product:string,psc:struct<cog_category:string,cog_id:string>,cog_category:string,cog_id:string>>"
    f = spark.read.json(path, schema=schema, multiLine=True).select(F.explode("features").alias("f"), F.col("_metadata.file_path").alias("source_file"))
    f = f.filter("f.type = 'cds'")
    return f.select("f.locus", "f.product", F.coalesce("f.cog_category", "f.psc.cog_category").alias("cog_category"), F.coalesce("f.cog_id", "f.psc.cog_id").alias("cog_id"), "source_file")


def read_metrics(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Metric JSON files, nested (simple_metrics) or flat; names that hold summaries are left out."""
    names = ("accuracy", "precision", "recall", "f1", "mcc", "auc")
    inner = ",".join(f"{n}:double" for n in names)
    rows = spark.read.json(path, schema=f"simple_metrics struct<{inner}>, " + ", ".join(f"{n} double" for n in names), multiLine=True).select("*", F.col("_metadata.file_path").alias("source_file"))
    name = F.lower(F.element_at(F.split("source_file", "/"), -1))
    for w in METRIC_WORDS:
        rows = rows.filter(~F.contains(name, F.lit(w)))
    return rows.select("source_file", *(F.coalesce(f"simple_metrics.{n}", n).alias(n) for n in names))


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The first token of every line that isn't blank."""
    return spark.read.text(path).select(F.regexp_extract(F.trim("value"), r"^(\S+)", 1).alias("accession")).filter("accession <> ''")


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(genome, cluster, ordinal) of a table with a header; ordinal is the order in the file. Lines whose cluster is no number (the header) are left out."""
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    cells = F.split("value", "\t")
    rows = spark.read.text(path).select(cells[0].alias("genome"), F.get(cells, F.lit(1)).try_cast("int").alias("cluster"), at.alias("ordinal"))
    return rows.filter("cluster IS NOT NULL")


def first_of_clusters(clusters: DataFrame) -> DataFrame:
    """(cluster, genome, members): the genome that comes first in the file stands for its cluster."""
    return clusters.groupBy("cluster").agg(F.min_by("genome", "ordinal").alias("genome"), F.count("*").alias("members"))


def read_mash(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Distances between genomes named by file: folders and endings are cut off."""
    rows, _ = read_delimited(spark, path, MASH, comment="#")
    stem = lambda c: F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.(fa|fna|fasta)(\.gz)?$", "")
    return rows.select(stem("query").alias("query"), stem("reference").alias("reference"), "distance")


#: Columns of prediction files; a file may lack any but the probabilities, and have others, in any order.
PREDICTION_COLUMNS = ("segment_id", "seq_id", "label", "start", "end", "prob_0", "prob_1", "pred_label")


def read_predictions(spark: SparkSession, root: str) -> DataFrame:
    """All *_predictions.csv below root/model/category/window with these four as columns, and PREDICTION_COLUMNS as text; folders that begin with _ are skipped.

    Files are read by their own headers: those with the same header are one scan, in which columns that aren't asked for are pruned.
    Columns that a file lacks are null. A header is a line that names both probabilities.
    """
    option = {"recursiveFileLookup": "true", "pathGlobFilter": "*_predictions.csv"}
    lines = spark.read.options(**option).text(root).filter(F.contains("value", F.lit("prob_0")) & F.contains("value", F.lit("prob_1")))
    layouts: dict[str, list[str]] = {}
    for row in lines.select("value", F.col("_metadata.file_path").alias("path")).distinct().collect():  # a header a file, as in the driver's list of files
        layouts.setdefault(row["value"], []).append(row["path"])
    out = None
    for header, paths in sorted(layouts.items()):
        names = [n.strip().strip('"') for n in header.lstrip("\ufeff").rstrip("\r").split(",")]
        rows = spark.read.csv(sorted(paths), header=True, schema=", ".join(f"`{n}` string" for n in names), maxCharsPerColumn=-1, escape='"')
        path = F.col("_metadata.file_path")
        part = lambda i: F.regexp_extract(path, r"([^/]+)/([^/]+)/([^/]+)/([^/]+)_predictions\.csv$", i)  # noqa: B023, E731
        columns = [F.col(f"`{n}`") if n in names else F.lit(None).cast("string").alias(n) for n in PREDICTION_COLUMNS]
        rows = rows.select(part(1).alias("model"), part(2).alias("category"), part(3).alias("window"), part(4).alias("input_file"), *columns)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], ", ".join(f"`{n}` string" for n in ("model", "category", "window", "input_file", *PREDICTION_COLUMNS)))
    return out.filter(~(F.col("model").startswith("_") | F.col("category").startswith("_") | F.col("window").startswith("_")))


def read_label_folders(spark: SparkSession, root: str) -> DataFrame:
    """root/split/label/file: whole texts with split, label name and a label number by the names' order."""
    rows = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
    part = lambda i: F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/([^/]+)/([^/]+)$", i)
    rows = rows.select(part(1).alias("split"), part(2).alias("label_name"), part(3).alias("file"), "value")
    names = rows.select("label_name").distinct().withColumn("label", F.row_number().over(Window.orderBy("label_name")) - 1)
    return rows.join(F.broadcast(names), "label_name")  # as many rows as there are label folders


def read_splits(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """train, dev (or val) and test CSV of a folder in one table with the column split."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    out = None
    for split, names in (("train", ("train",)), ("dev", ("dev", "val", "valid")), ("test", ("test",))):
        for name in names:
            path = hadoop.Path(f"{root}/{name}.csv")
            if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
                part = read_csv(spark, f"{root}/{name}.csv", schema).withColumn("split", F.lit(split))
                out = part if out is None else out.unionByName(part)
                break
    if out is None:
        raise FileNotFoundError(f"no split in {root}")
    return out


def sequence_column(df: DataFrame) -> Column:
    """The first of the usual names of a sequence column that df has."""
    for name in ("sequence", "seq", "dna_sequence", "dna_seq", "text"):
        if name in df.columns:
            return F.col(name)
    raise ValueError(f"no sequence column among {df.columns}")


def require_columns(df: DataFrame, names: list[str]) -> None:
    """An error that lists the columns that are missing."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"The following columns are missing: {missing}")


def is_primary_key(df: DataFrame, column: str) -> bool:
    """Whether a column has no nulls and no repeated values."""
    require_columns(df, [column])
    return df.groupBy(column).agg(F.count("*").alias("n")).filter(F.col(column).isNull() | (F.col("n") > 1)).isEmpty()


def read_arrays(spark: SparkSession, path: str | list[str], length: int | None = None) -> DataFrame:
    """.npy files as (source_file, values): the first column of two-dimensional ones; padded with 0 or cut to length."""
    @F.pandas_udf("array<double>")
    def load(content: pd.Series) -> pd.Series:
        out = []
        for raw in content:
            a = np.load(io.BytesIO(raw), allow_pickle=False)
            a = a[:, 0] if a.ndim == 2 else a
            if length is not None:
                a = np.pad(a[:length], (0, max(0, length - len(a))))
            out.append(a.astype(float).tolist())
        return pd.Series(out)

    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("source_file"), load("content").alias("values"))


def write_delimited(df: DataFrame, path: str, sep: str = ",", digits: int | None = None, header: bool = True, mode: str = "error") -> None:
    """CSV or TSV in the columns' order; doubles with fixed digits if given; null is empty."""
    if digits is not None:
        df = df.select(*(F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", F.col(c))).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))
    df.write.mode(mode).csv(path, sep=sep, header=header, emptyValue="", nullValue="", escape='"')


def write_bed(df: DataFrame, path: str, keys: list[str], name: str = "region", mode: str = "error") -> None:
    """(seq_id, start, end, name_n, score, strand) numbered per keys in order of place."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("start", "end"))
    rows = df.select("seq_id", "start", "end", F.concat(F.lit(f"{name}_"), n.cast("string")).alias("name"), F.coalesce(F.col("score") if "score" in df.columns else F.lit(None), F.lit(0)).alias("score"), F.lit("+").alias("strand"))
    write_delimited(rows, path, sep="\t", header=False, mode=mode)


def write_documents(df: DataFrame, path: str, key: str, mode: str = "error") -> None:
    """One JSON object per key, in a folder per key."""
    df.select(key, F.to_json(F.struct(*df.columns)).alias("value")).write.mode(mode).partitionBy(key).text(path)


def equal_chunks(df: DataFrame, order: str, n: int) -> DataFrame:
    """df with chunk from 1 to n in order, of equal numbers of rows (the first ones have one more); places are counted per range, not in one task."""
    from windrow.operators.selection import placed

    ids = placed(df.select(order), order)
    total = ids.count()
    size, more = total // n, total % n
    p = F.col("place")
    head = more * (size + 1)
    chunk = F.when(p < head, F.floor(p / F.lit(size + 1))).otherwise(F.lit(more) + F.floor((p - head) / F.lit(max(1, size)))) + 1
    return df.join(ids.select(order, chunk.cast("int").alias("chunk")), order)
