"""Written tables in the folder that driver and executors share: they cut lineage, so a lost
executor costs no recomputation of what is written."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where a local session names no spark.checkpoint.dir (tests, a laptop).
FALLBACK_DIR = "file:///tmp/checkpoints"


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share, one per application, removed at exit."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = FALLBACK_DIR
    root = f"{base.rstrip('/')}/quire-{spark.sparkContext.applicationId}"
    if root not in _cleaned:
        _cleaned.add(root)
        atexit.register(_remove, spark, root)
    return root


_cleaned: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended first; the folder is scratch
        pass


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts the
    lineage, and a lost executor costs no recomputation of what is written."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def forget(table: DataFrame) -> None:
    """Remove a table that written() gave, once what is made from it has been written."""
    _remove(table.sparkSession, table._scratch_path)
