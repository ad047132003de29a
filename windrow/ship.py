"""Making this package importable in Spark's Python workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers of this session's application, once."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    home = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="windrow-ship-")  # the driver's; Spark hands the file on
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    to = Path(folder) / f"{home.name}.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(home.rglob("*.py")):
            archive.write(file, f"{home.name}/{file.relative_to(home)}")
    context.addPyFile(str(to))
    _shipped.add(context.applicationId)


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """df.mapInArrow for functions that use this package."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def map_groups(df: DataFrame, keys: list[str], function, schema: str) -> DataFrame:
    """Grouped applyInPandas for functions that use this package."""
    ship(df.sparkSession)
    return df.groupBy(*keys).applyInPandas(function, schema)


def with_run_columns(df: DataFrame, keys: list[str], order: list[str], value: str, compute, names: list[str]) -> DataFrame:
    """df with double columns that compute(values of a key in order) returns, a list of arrays as long as the values.

    Rows are partitioned by key and sorted, and stream through in batches; only the key that a batch ends in is held. So many
    small keys cost no call into Python each, and no task holds more than one key.
    """
    columns = df.columns

    def runs(pdf: pd.DataFrame) -> np.ndarray:
        new = np.ones(len(pdf), bool)
        if len(pdf) > 1:
            same = np.ones(len(pdf) - 1, bool)
            for k in keys:
                c = pdf[k]
                gone = c.isna().to_numpy()
                v = c.to_numpy(dtype=object)
                same &= ((v[1:] == v[:-1]) & ~gone[1:] & ~gone[:-1]) | (gone[1:] & gone[:-1])
            new[1:] = ~same
        return np.flatnonzero(new)

    def computed(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        v = pdf[value].to_numpy(dtype=float)
        parts = [compute(v[a:b]) for a, b in zip(starts, [*starts[1:], len(v)], strict=True)]
        return pdf.assign(**{n: np.concatenate([p[i] for p in parts]) for i, n in enumerate(names)})

    def run(batches):
        held: list[pd.DataFrame] = []  # of the key that the last batch ended in

        def settled() -> pd.DataFrame:
            return computed(pd.concat(held, ignore_index=True) if len(held) > 1 else held[0], np.array([0]))

        for pdf in batches:
            if not len(pdf):
                continue
            starts = runs(pdf)
            if held and len(runs(pd.concat([held[-1].iloc[-1:], pdf.iloc[:1]], ignore_index=True))) > 1:
                yield settled()
                held = []
            if len(starts) == 1:
                held.append(pdf)
                continue
            held.append(pdf.iloc[: starts[1]])
            yield settled()
            if len(starts) > 2:
                yield computed(pdf.iloc[starts[1] : starts[-1]], starts[1:-1] - starts[1])
            held = [pdf.iloc[starts[-1] :]]
        if held:
            yield settled()

    ship(df.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in columns)
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return rows.mapInPandas(run, fields + "".join(f", `{n}` double" for n in names))
