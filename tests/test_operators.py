"""Limits of the operators over ordered blocks and parent pointers."""

from pyspark.sql import functions as F

from quire.operators import ancestors, sequences


def test_a_list_item_is_seen_51_rows_ahead(spark):
    rows = [(doc, k, "7" if k == gap else None) for doc, gap in (("a", 51), ("b", 52)) for k in range(gap + 1)]
    df = spark.createDataFrame(rows, "doc string, k int, item string")
    ahead = sequences.same_ahead(["doc"], ["k"], F.col("item"), F.lit(False), F.lit("7"))
    got = {(r["doc"], r["k"]): r["ahead"] for r in df.select("doc", "k", ahead.alias("ahead")).collect()}
    assert got["a", 0] and got["b", 1] and not got["b", 0]


def test_ancestors_are_found_however_far_and_cycles_end(spark):
    chain = [("chain", k, k - 1 if k else None, k == 0) for k in range(100)]
    cycle = [("cycle", k, (k + 1) % 70, False) for k in range(70)]
    nodes = spark.createDataFrame(chain + cycle, "doc string, n int, parent int, has boolean")
    got = {(r["doc"], r["n"]): (r["found"], r["depth"]) for r in ancestors.nearest(nodes, "n", "parent", "has", ["doc"]).collect()}
    assert got == {("chain", k): (0, k) for k in range(100)} | {("cycle", k): (None, None) for k in range(70)}
    assert ancestors.nearest(nodes.limit(0), "n", "parent", "has", ["doc"]).count() == 0
