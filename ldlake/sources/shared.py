"""The folder that driver and executors share, and what is kept there: checkpoints and tables between stages."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where the setting is absent, a temporary folder is made if driver and executors are one machine
    (``local`` masters, as in tests); on a cluster that is an error.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="ldlake-")
        atexit.register(shutil.rmtree, at.removeprefix("file://"), ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder; what isn't there is no error."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """The table, computed once and kept in the shared folder by columns, of which readers take what they need.

    Tables that files by columns can't hold as they are (columns of one name, or of no type) are checkpointed.
    """
    names = [c.lower() for c in df.columns]
    if len(set(names)) < len(names) or any(kind in str(df.schema) for kind in ("NullType", "IntervalType", "VariantType", "UserDefinedType")):
        return cut(df)
    at = fresh_dir(df.sparkSession, "rows")
    df.write.option("maxRecordsPerFile", 0).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
