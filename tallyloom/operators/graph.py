"""Connected components over edge tables, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyloom.session import materialize, release


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Smallest reachable node for every node of an undirected edge table.

    ``edges`` has columns (u, v) of one orderable type. Returns (node, component): one row for
    each node that occurs in an edge with two different ends; component is the smallest node of
    its component. Nulls and loops are ignored, repeated edges count once, an empty table gives
    an empty table. Each round takes minima with a map-side aggregate and joins them back, so a
    hub with any number of edges is never gathered in one task. The state is written to the
    shared folder after each round.
    """
    kind = edges.schema["u"].dataType
    pairs = edges.where("u is not null and v is not null and u <> v")
    state = materialize(
        pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components"
    )
    mark = _mark(state)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        old, state = state, materialize(_small_star(_large_star(state)), "components")
        seen, mark = mark, _mark(state)
        release(old)
        if seen == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labels = state.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return labels.unionByName(roots).select(F.col("node").cast(kind), F.col("component").cast(kind))


def _mark(state: DataFrame) -> tuple:
    row = state.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
    return row.n, row.x


def _large_star(state: DataFrame) -> DataFrame:
    both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(state: DataFrame) -> DataFrame:
    least = state.groupBy("u").agg(F.min("v").alias("low"))
    moved = state.join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("low").alias("v"))).distinct()
