"""Shared helpers: tables, session settings, folds."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.scratch import forget, scratch, shared_root, written  # noqa: F401  one place for them all

#: ASCII white space as Java, RE2 and Python regexes all write it.
ASCII_WS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what one Arrow batch of long texts holds in a Python worker, and let workers
    import this package wherever the driver runs."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def unused(columns: list[str], name: str) -> str:
    """The name, lengthened until it is none of the columns'."""
    while name.lower() in map(str.lower, columns):
        name += "_"
    return name


def in_fold(col: str, n: int, fold: int):
    """Whether crc32 of the id as text, modulo n, is fold; a null id is in none."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % F.lit(n) == fold, F.lit(False))


@contextlib.contextmanager
def uncollected():
    """No cycle collection: for code that makes no cycles and keeps caches that are slow to walk."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


#: What this worker keeps from task to task, by the step that it is for.
_kept: dict[str, Any] = {}


def alone(step: str, make: Callable[[], Any] | None = None) -> Any:
    """What a worker keeps for this step from task to task, made once. What it has kept for
    another step is let go first and goes back to the system: the steps of a pipeline run in
    the same workers, one after the other, and their memory would add up."""
    if step not in _kept:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
            ctypes.CDLL(None).malloc_trim(0)
        _kept[step] = make() if make else None
    return _kept[step]


def small_table(spark: SparkSession, columns: dict[str, pa.Array]) -> DataFrame:
    """A table of the driver's, by Arrow. A list of rows would go through an RDD, and RDDs have
    Python workers of their own in each executor, beside those of queries."""
    return spark.createDataFrame(pa.table(columns))


#: Most keys of a join that are looked up in a broadcast table.
HOT_KEYS, HOT_ROWS = 1_000, 16


def join_unique(big: DataFrame, small: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """big, a written table, joined (inner or left) with small, which has each key once.

    The HOT_KEYS most frequent keys of big (of those with more than HOT_ROWS rows) are
    joined by broadcast: at most HOT_KEYS rows of small, whatever the input. Of the others
    none has more than a HOT_KEYS-th of big's rows, so no task gets a hot key; nor do null
    keys meet, which join nothing.
    """
    keys = [key] if isinstance(key, str) else key
    known = big.dropna(subset=keys)
    counts = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_ROWS)
    hot = F.broadcast(written(counts.orderBy(F.desc("_n"), *keys).limit(HOT_KEYS).select(*keys), "hot-keys"))
    warm = known.join(F.broadcast(hot.join(small, keys, how)), keys)
    out = warm.unionByName(known.join(hot, keys, "left_anti").join(small, keys, how))
    if how == "left":
        lost = big.where(" or ".join(f"`{k}` is null" for k in keys))
        out = out.unionByName(lost, allowMissingColumns=True)
    return out
