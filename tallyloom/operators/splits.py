"""Leakage-free splits: isolation components, hold-outs, challenges and overlap audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.functions.scalars import id_set_digest
from tallyloom.operators.graph import connected_components


def axis_values(rows: DataFrame, id_column: str, axes: list[str]) -> DataFrame:
    """(id, axis, value) for every value of every axis that is there; an axis may be an array."""
    parts = []
    for axis in axes:
        kind = rows.schema[axis].dataType.typeName()
        value = F.explode(axis) if kind == "array" else F.col(axis).cast("string")
        parts.append(rows.select(F.col(id_column).alias("id"), F.lit(axis).alias("axis"), value.alias("value")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where("value IS NOT NULL AND value <> ''")


def isolation_components(values: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, component): rows that share a value on some axis, directly or through others, are one component.

    Each value links its rows to the smallest of them, so a value with any number of rows adds one
    edge for each row and never all pairs. Values become a digest first.
    """
    v = values.select("id", F.sha2(F.concat_ws(":", "axis", "value").cast("binary"), 256).alias("value"))
    least = v.groupBy("value").agg(F.min("id").alias("low"))
    edges = v.join(least, "value").where("id <> low").select(F.col("id").alias("u"), F.col("low").alias("v")).distinct()
    found = connected_components(edges)
    return ids.select("id").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def component_report(components: DataFrame) -> DataFrame:
    """Size, first id and digest of the sorted ids of each component."""
    t = components.groupBy("component").agg(F.count("*").alias("size"), F.min("id").alias("first_id"), id_set_digest(F.col("id")).alias("ids_sha256"))
    return t.withColumn("component_id", F.concat(F.lit("component-"), F.substring("ids_sha256", 1, 16)))


def strict_partition(components: DataFrame, share: float) -> DataFrame:
    """(id, component, side): whole components held out, the last ones in the order of their digests.

    With fewer than two components there is no split, and side is null. Only the table of
    components is ordered as a whole.
    """
    report = component_report(components)
    n = F.count("*").over(Window.partitionBy())
    held = F.least(F.greatest(F.lit(1), F.floor(n * share)), n - 1)
    place = F.row_number().over(Window.orderBy(F.desc("ids_sha256"), F.desc("first_id")))
    side = F.when(n < 2, None).when(place <= held, "test").otherwise("train")
    return components.join(report.select("component", side.alias("side")), "component").select("id", "component", "side")


def holdout_values(rows: DataFrame, axis: str, share: float, by_entities: str | None = None) -> DataFrame:
    """Values of an axis that are held out: the last ones, or those that touch the fewest entities."""
    if by_entities:
        values = rows.where(F.col(axis).isNotNull()).groupBy(axis).agg(F.count_distinct(by_entities).alias("touched"))
        order = Window.orderBy("touched", axis)
    else:
        values = rows.where(F.col(axis).isNotNull()).select(axis).distinct()
        order = Window.orderBy(F.desc(axis))
    n = F.count("*").over(Window.partitionBy())
    t = values.select(axis, F.row_number().over(order).alias("place"), n.alias("n"))
    return t.where((F.col("n") >= 2) & (F.col("place") <= F.least(F.greatest(F.lit(1), F.floor(F.col("n") * share)), F.col("n") - 1))).select(axis)


def challenge(rows: DataFrame, axis: str, entities: list[str], held: DataFrame) -> DataFrame:
    """``rows`` with side: test where the axis is held out; train rows that share an entity with test are dropped."""
    test = rows.join(held, axis, "left_semi").withColumn("side", F.lit("test"))
    train = rows.join(held, axis, "left_anti")
    for entity in entities:
        train = train.join(test.select(entity).where(F.col(entity).isNotNull()).distinct(), entity, "left_anti")
    return test.unionByName(train.withColumn("side", F.lit("train")).select(test.columns))


def leakage(values: DataFrame, sides: DataFrame) -> DataFrame:
    """Per axis: distinct values in train, in test, and in both."""
    t = values.join(sides.where("side IS NOT NULL").select("id", "side"), "id")
    per = t.groupBy("axis", "value").agg(F.bool_or(F.col("side") == "train").alias("a"), F.bool_or(F.col("side") == "test").alias("b"))
    return per.groupBy("axis").agg(F.count_if("a").alias("n_train"), F.count_if("b").alias("n_test"), F.count_if(F.col("a") & F.col("b")).alias("n_overlap"))


def bridges(rows: DataFrame, template: str, across: str) -> DataFrame:
    """Templates that occur in more than one environment or site."""
    return rows.groupBy(template).agg(F.count_distinct(across).alias("places"), F.count("*").alias("n")).where("places > 1")


def hashed_validation(entity: Column, share: float) -> Column:
    """Stable assignment of an entity to validation by its hash; shares are held within 0 and one half."""
    from tallyloom.functions.scalars import hash_mod

    return hash_mod(entity, 1000) < int(max(0.0, min(0.5, share)) * 1000)
