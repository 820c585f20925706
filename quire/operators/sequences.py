"""Ordered operators over blocks of a document, as window expressions.

Every window is partitioned by the document, so one shuffle on it serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, doc: list[str], order: list[str], key: str, name: str = "island") -> DataFrame:
    """Number the runs of equal keys, from 1."""
    w = Window.partitionBy(*doc).orderBy(*order)
    starts = (~F.lag(key).over(w).eqNullSafe(F.col(key))) | (F.row_number().over(w) == 1)
    return df.withColumn("_start", starts.cast("int")).withColumn(name, F.sum("_start").over(w)).drop("_start")


def running_counter(doc: list[str], order: list[str], start: Column) -> Column:
    """start, start + 1, … within the partition."""
    return start + F.row_number().over(Window.partitionBy(*doc).orderBy(*order)) - 1


def same_ahead(doc: list[str], order: list[str], item: Column, barrier: Column, num: Column, most: int = 50) -> Column:
    """Whether the next list item, this row's own counted and up to `most` others before it
    passed, is one of list `num`, with no barrier before it. item is null for rows that are
    no list items."""
    w = Window.partitionBy(*doc).orderBy(*order).rowsBetween(0, most + 1)
    event = F.when(barrier, F.struct(F.lit(True).alias("stop"), F.lit(None).cast("string").alias("item"))).when(item.isNotNull(), F.struct(F.lit(False).alias("stop"), item.cast("string").alias("item")))
    first = F.first_value(event, True).over(w)
    return F.coalesce(~first["stop"] & (first["item"] == num), F.lit(False))


def grid_column(table: list[str], order: list[str], span: Column) -> Column:
    """Column a cell starts at: the spans of the cells before it in its row."""
    w = Window.partitionBy(*table).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(F.greatest(span, F.lit(1))).over(w), F.lit(0))


def merge_groups(df: DataFrame, column: list[str], order: list[str], restart: Column, proceed: Column) -> DataFrame:
    """Vertical merges within a grid column: merge_group counts the restarts so far, omitted
    is a continuing cell below one, row_span is 1 + the group's continuing cells at a
    restart, 2 at a continuing cell that has none above, else null."""
    w = Window.partitionBy(*column).orderBy(*order)
    df = df.withColumn("merge_group", F.sum(restart.cast("int")).over(w))
    below = F.col("merge_group") > 0
    within = Window.partitionBy(*column, "merge_group")
    span = F.sum(proceed.cast("int")).over(within) + 1
    return df.withColumn("omitted", proceed & below).withColumn("row_span", F.when(restart & (span > 1), span).when(proceed & ~below, F.lit(2).cast("long")))


def first_occurrences(df: DataFrame, doc: list[str], keys: list[str], order: list[str]) -> DataFrame:
    """Distinct by keys, the first row of each in order."""
    w = Window.partitionBy(*doc, *keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def first_filled(df: DataFrame, doc: list[str], order: str, value: str) -> DataFrame:
    """doc, value: the first in order that is neither null nor empty; null if none is."""
    filled = F.nullif(F.col(value), F.lit(""))
    return df.groupBy(*doc).agg(F.min_by(filled, F.when(filled.isNotNull(), F.col(order))).alias(value))


def tab_overlay(stops: DataFrame, doc: list[str], pos: str, direct: str, order: str, align: str) -> DataFrame:
    """Tab stops by position: of a position's stops the last own one counts, else the last
    inherited one; an own stop that clears leaves none."""
    last = stops.groupBy(*doc, pos).agg(F.max(F.struct(direct, order, align)).alias("_stop"))
    return last.where(~(F.col("_stop")[direct] & (F.col("_stop")[align] == "clear"))).select(*doc, pos, F.col("_stop")[align].alias(align))


def stacked(doc: list[str], order: str, *tables: DataFrame) -> DataFrame:
    """doc, block (from 0), seq (from 0), line: the tables' lines one table after the other, each in order."""
    out = None
    for k, table in enumerate(tables):
        part = table.select(*doc, F.lit(k).alias("block"), (F.row_number().over(Window.partitionBy(*doc).orderBy(order)) - 1).alias("seq"), "line")
        out = part if out is None else out.unionByName(part)
    return out


def preorder_ids(nodes: DataFrame, doc: list[str], path: list[str], name: str = "id") -> DataFrame:
    """Number nodes from 1, a node before those within it: path columns are null below a node's own level."""
    w = Window.partitionBy(*doc).orderBy(*[F.col(c).asc_nulls_first() for c in path])
    return nodes.withColumn(name, F.row_number().over(w))
