"""Nearest ancestor that defines a property, along parent pointers that may form cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.scratch import written


def nearest(nodes: DataFrame, node: str, parent: str, defines: str, doc: list[str]) -> DataFrame:
    """doc…, node, found (null if none), depth (0: the node itself).

    Pointer doubling: each round a node without an answer takes its pointer's answer, or
    its pointer's pointer, so a chain of n parents takes log2(n) equi-joins, none of which
    grows; each round is written, as the next reads it twice. No chain has more parents than
    its document has nodes, which bounds the rounds of a cycle too. A chain that comes back to itself or leaves the table has no answer.
    """
    has = F.coalesce(F.col(defines), F.lit(False))
    state = nodes.select(*doc, F.col(node).alias("_n"), F.when(has, F.col(node)).alias("_found"), F.when(~has, F.col(parent)).alias("_ptr"), F.when(has, 0).otherwise(1).alias("_d"))
    most = nodes.groupBy(*doc).count().agg(F.max("count")).first()[0] or 0
    for _ in range(most.bit_length()):
        up = state.select(*doc, F.col("_n").alias("_ptr"), F.col("_found").alias("_f2"), F.col("_ptr").alias("_p2"), F.col("_d").alias("_d2"))
        joined = state.join(up, [*doc, "_ptr"], "left")
        open_ = F.col("_found").isNull() & F.col("_ptr").isNotNull()
        state = written(joined.select(*doc, "_n", F.coalesce("_found", F.when(open_, F.col("_f2"))).alias("_found"), F.when(open_, F.col("_p2")).alias("_ptr"), F.when(open_, F.col("_d") + F.coalesce("_d2", F.lit(0))).otherwise(F.col("_d")).alias("_d")), "ancestors")
        if not state.where("_found is null and _ptr is not null").limit(1).count():
            break
    return state.select(*doc, F.col("_n").alias(node), F.col("_found").alias("found"), F.when(F.col("_found").isNotNull(), F.col("_d")).alias("depth"))
