"""Simple models on features of segments, and sketches of sequences for their distances."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.functions.sequences import kmers, reverse_complement
from windrow.storage import materialize


def kmer_vector(sequence: str | Column, k: int = 4) -> Column:
    """Relative frequencies of the words over A, C, G, T in lexical order; zeros where there is none."""
    words = F.filter(kmers(sequence, k), lambda w: w.rlike("^[ACGT]+$"))
    numbers = F.transform(words, lambda w: F.conv(F.translate(w, "ACGT", "0123"), 4, 10).cast("int"))
    # sorted numbers with a sentinel per word: the count of a word is the distance between neighbouring sentinels
    counts = F.transform(F.sequence(F.lit(0), F.lit(4**k - 1)), lambda i: F.size(F.filter(numbers, lambda n: n == i)))
    total = F.size(numbers)
    return F.transform(counts, lambda c: F.when(total > 0, c / total).otherwise(0.0))


def with_vector(df: DataFrame, column: str, name: str = "features") -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn(name, array_to_vector(F.col(column).cast("array<double>")))


def linear_probe(train: DataFrame, test: DataFrame, features: str, label: str = "label", iterations: int = 1000) -> DataFrame:
    """test with prob_1 and pred of a logistic regression on standardised features (L2 of strength 1 over the number of rows)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import vector_to_array

    a, b = with_vector(train, features, "_raw"), with_vector(test, features, "_raw")
    scaler = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(a)
    n = a.count()
    model = LogisticRegression(featuresCol="_x", labelCol=label, maxIter=iterations, regParam=1.0 / max(1, n), standardization=False, predictionCol="_p", probabilityCol="_q", rawPredictionCol="_z").fit(scaler.transform(a))
    out = model.transform(scaler.transform(b))
    return out.withColumns({"prob_1": vector_to_array("_q")[1], "pred": F.col("_p").cast("int")}).drop("_raw", "_x", "_p", "_q", "_z")


def perceptron(train: DataFrame, test: DataFrame, features: str, width: int, hidden: tuple[int, ...] = (256, 128), label: str = "label", seed: int = 1, iterations: int = 100) -> DataFrame:
    """test with prob_1 and pred of a multilayer perceptron. Its hidden units are sigmoids and nothing is dropped out, so it only approximates one of rectified units."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import vector_to_array

    a, b = with_vector(train, features, "_x"), with_vector(test, features, "_x")
    model = MultilayerPerceptronClassifier(featuresCol="_x", labelCol=label, layers=[width, *hidden, 2], seed=seed, maxIter=iterations, predictionCol="_p", probabilityCol="_q", rawPredictionCol="_z").fit(a)
    out = model.transform(b)
    return out.withColumns({"prob_1": vector_to_array("_q")[1], "pred": F.col("_p").cast("int")}).drop("_x", "_p", "_q", "_z")


def explained_variance(df: DataFrame, features: str, components: int = 2) -> list[float]:
    """Shares of variance of the first principal components of standardised features."""
    from pyspark.ml.feature import PCA, StandardScaler

    rows = with_vector(df.select(features), features, "_raw")
    scaled = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(rows).transform(rows)
    return [float(v) for v in PCA(k=components, inputCol="_x", outputCol="_y").fit(scaled).explainedVariance]


#: Queries of the silhouette that meet the rows in one pass.
MAX_QUERIES = 20_000


def silhouette(df: DataFrame, key: str, features: str, label: str, every: int = 100) -> DataFrame:
    """(key, label, a, b, silhouette), exact and Euclidean, of the rows whose key is divisible by every.

    The queries meet all rows in passes of MAX_QUERIES: each task sums the distances of its rows to every query
    per label, and the sums are added up. No pair of rows is set out. Of several passes each is written to the shared folder.
    """
    chosen = df.filter((F.col(key) % every == 0) & F.col(label).isNotNull()).select(key, label, features)
    total = chosen.count()
    if total <= MAX_QUERIES:
        return _silhouette_of(df, chosen.collect(), key, features, label)
    out = None
    rows = materialize(chosen, "queries").orderBy(key).toLocalIterator()
    while block := list(islice(rows, MAX_QUERIES)):
        one = materialize(_silhouette_of(df, block, key, features, label), "silhouette")
        out = one if out is None else out.unionByName(one)
    return out


def _silhouette_of(df: DataFrame, queries: list, key: str, features: str, label: str) -> DataFrame:
    """The silhouette of some rows (key, label, features) against all of df."""
    if not queries:
        return df.sparkSession.createDataFrame([], f"{key} bigint, {label} int, a double, b double, silhouette double")
    ids = np.array([r[0] for r in queries], np.int64)
    q = np.array([r[2] for r in queries], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), np.float64)
            labels = batch.column("y").to_numpy(zero_copy_only=False)
            for lab in np.unique(labels):
                mine = x[labels == lab]
                total, n = sums.setdefault(int(lab), [np.zeros(len(q)), np.zeros(1)])
                for i in range(0, len(mine), 256):
                    d = (q**2).sum(axis=1)[:, None] + (mine[i : i + 256] ** 2).sum(axis=1)[None, :] - 2 * q @ mine[i : i + 256].T
                    total += np.sqrt(np.maximum(d, 0)).sum(axis=1)
                n += len(mine)
        for lab, (total, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), lab, np.int32)), pa.array(total), pa.array(np.full(len(ids), n[0]))], names=["key", "other", "total", "n"])

    rows = df.filter(F.col(label).isNotNull()).select(F.col(features).alias("x"), F.col(label).cast("int").alias("y"))
    per = rows.mapInArrow(run, "key bigint, other int, total double, n double").groupBy("key", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    own = df.sparkSession.createDataFrame([(int(r[0]), int(r[1])) for r in queries], "key bigint, own int")
    j = per.join(own, "key")
    same = F.col("other") == F.col("own")
    out = j.groupBy("key", "own").agg(F.max(F.when(same & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"), F.min(F.when(~same, F.col("total") / F.col("n"))).alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return out.select(F.col("key").alias(key), F.col("own").alias(label), "a", "b", s.alias("silhouette"))


def sketch(sequence: str | Column, k: int = 21, size: int = 100) -> Column:
    """The least hashes (hexadecimal, 16 digits) of the distinct words of A, C, G, T and their complements."""
    # the words of the other strand, from its end, are the complements of those of this one
    words = F.zip_with(kmers(sequence, k), F.reverse(kmers(reverse_complement(sequence), k)), lambda a, b: F.least(a, b))
    hashes = F.transform(F.filter(words, lambda w: F.translate(w, "ACGT", "") == ""), lambda w: F.substring(F.md5(w), 1, 16))
    return F.slice(F.array_sort(F.array_distinct(hashes)), 1, size)


def sketch_distances(df: DataFrame, key: str, sequence: str, k: int = 21, size: int = 100, most: float = 0.2) -> DataFrame:
    """(a, b, jaccard, distance) of pairs whose sketch distance -ln(2j / (1 + j)) / k is at most most, a < b.

    Pairs are found by a shared hash in the prefix of the sketches: two sketches with a Jaccard similarity of at least t have
    one of the first (1 - t) of their hashes in common, so only those are joined.
    """
    import math

    t = math.exp(-k * most) / (2 - math.exp(-k * most))
    prefix = max(1, math.ceil((1 - t) * size) + 1)
    s = materialize(df.select(F.col(key).alias("k"), sketch(sequence, k, size).alias("s")).filter(F.size("s") > 0), "sketches")
    marks = s.select("k", F.explode(F.slice("s", 1, prefix)).alias("h"))
    a, b = marks.select(F.col("k").alias("a"), "h"), marks.select(F.col("k").alias("b"), "h")
    pairs = a.join(b, "h").filter("a < b").select("a", "b").distinct()
    full = pairs.join(s.select(F.col("k").alias("a"), F.col("s").alias("x")), "a").join(s.select(F.col("k").alias("b"), F.col("s").alias("y")), "b")
    union = F.slice(F.array_sort(F.array_union("x", "y")), 1, size)
    full = full.withColumn("jaccard", F.size(F.array_intersect(union, F.array_intersect("x", "y"))) / F.size(union)).filter("jaccard > 0")
    distance = -F.log(2 * F.col("jaccard") / (1 + F.col("jaccard"))) / k
    return full.select("a", "b", "jaccard", F.greatest(F.lit(0.0), distance).alias("distance")).filter(F.col("distance") <= most)


def numbered_clusters(components: DataFrame) -> DataFrame:
    """components(node, component) with cluster numbers from 0 by size, the greatest first; numbers are counted per range of sizes."""
    from windrow.operators.selection import placed

    sizes = components.groupBy("component").agg(F.count("*").alias("size")).withColumn("_o", F.struct((-F.col("size")).alias("s"), "component"))
    numbers = placed(sizes, "_o").select("component", "size", F.col("place").alias("cluster"))
    return components.join(numbers, "component").select("node", "cluster", "size")
