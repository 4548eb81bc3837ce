"""Exact joins between bodies, manifests and their parents, and duplicate and provenance audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def row_digest(*cols: str) -> Column:
    """SHA-256 of columns as JSON in the given order, nulls kept."""
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).cast("binary"), 256)


def body_manifest(body: DataFrame, manifest: DataFrame, key: str, digest: str) -> DataFrame:
    """Every id of either side with a status: ok, hash_mismatch, body_only or manifest_only."""
    b, m = body.select(key, F.col(digest).alias("_b"), F.lit(True).alias("_in_b")), manifest.select(key, F.col(digest).alias("_m"), F.lit(True).alias("_in_m"))
    status = F.when(F.col("_in_m").isNull(), "body_only").when(F.col("_in_b").isNull(), "manifest_only").when(F.col("_b").eqNullSafe(F.col("_m")), "ok").otherwise("hash_mismatch")
    return b.join(m, key, "full_outer").select(key, status.alias("status"))


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key).distinct(), key, "left_anti")


def closure(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Parents of each child key counted: missing, ambiguous or exact."""
    n = parents.groupBy(key).agg(F.count("*").alias("parents"))
    t = children.groupBy(key).agg(F.count("*").alias("children")).join(n, key, "left")
    p = F.coalesce("parents", F.lit(0))
    return t.select(key, "children", p.alias("parents"), F.when(p == 0, "missing").when(p > 1, "ambiguous").otherwise("exact").alias("status"))


def insert_only(existing: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """Immutable upsert: what happens to each new id (insert, same or collision)."""
    old = existing.select(key, F.col(digest).alias("_old"))
    t = new.join(old, key, "left")
    return t.select(key, F.when(F.col("_old").isNull(), "insert").when(F.col("_old") == F.col(digest), "same").otherwise("collision").alias("action"))


def functional_dependency(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Values of ``left`` that go with more than one value of ``right``."""
    return rows.groupBy(left).agg(F.count_distinct(right).alias("values")).where("values > 1")


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def latest_known(rows: DataFrame, key: str, order: str, value: str, unknown: str, last: bool = True) -> DataFrame:
    """Per key the latest known value; if all are unknown, the last row or the first."""
    known = F.col(value) != unknown
    rank = F.struct(known.cast("int"), F.when(known | F.lit(last), F.col(order)).otherwise(-F.col(order)))
    return rows.groupBy(key).agg(F.max_by(F.struct(value, order), rank).alias("r")).select(key, "r.*")


def merge_overlays(events: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """Maps of each key merged in order, later values winning, with the number of events."""
    t = events.select(key, order, F.explode(payload).alias("name", "value"))
    w = Window.partitionBy(key, "name").orderBy(F.desc(order))
    won = t.withColumn("r", F.row_number().over(w)).where("r = 1")
    maps = won.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("merged"))
    return maps.join(events.groupBy(key).agg(F.count("*").alias("events"), F.max(order).alias("last")), key)
