"""Where intermediate tables live: the folder that all executors share.

The folder is the session's ``spark.checkpoint.dir``. Where that is unset (tests, one
machine) a temporary folder of this machine is used; on a cluster the setting is required.
Tables are written as Parquet, so a lost executor loses nothing and a later read prunes columns.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_own: dict[str, str] = {}
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, without a slash at its end."""
    at = spark.conf.get(_SETTING, None)
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError(f"{_SETTING} must name a folder that all executors share (master is {master})")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="windrow-")
    return _own[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and return it read back with the same columns: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/windrow/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    remember(path, spark)
    return spark.read.schema(df.schema).parquet(path)


def remember(path: str, spark: SparkSession) -> None:
    """Delete this path when the process ends."""
    _written[path] = spark


def _delete(path: str, spark: SparkSession) -> None:
    plain = path.removeprefix("file://").removeprefix("file:")
    if plain.startswith("/") and os.path.isdir(plain):  # also when the session has ended already
        shutil.rmtree(plain, ignore_errors=True)
        return
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def cleanup() -> None:
    """Delete the tables written by this process. Results that still read them must be done."""
    for path, spark in list(_written.items()):
        try:
            _delete(path, spark)
        except Exception:  # the session may have ended before the process
            pass
        _written.pop(path, None)
