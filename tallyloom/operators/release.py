"""Release views: overlays with exclusion reasons, gates, quality reports, audits of lineage and visibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.functions import scalars as S

# Keys whose values are credentials.
SECRET_KEYS = ("api_key", "apikey", "authorization", "cookie", "password", "secret", "token")


def export_overlay(rows: DataFrame, key: str, decisions: DataFrame, replacements: DataFrame, text: str) -> DataFrame:
    """Rows with their final text and the reasons that exclude them.

    ``decisions`` has (key, status): rejected and needs_review exclude a row, and so do two
    statuses that contradict each other. ``replacements`` has (key, text) and puts another text in
    its place; a replacement that is there twice excludes the row.
    """
    d = decisions.groupBy(key).agg(F.array_sort(F.collect_set("status")).alias("_status"))
    r = replacements.groupBy(key).agg(F.max(text).alias("_text"), F.count("*").alias("_n"))
    t = rows.join(d, key, "left").join(r, key, "left")
    has = lambda s: F.coalesce(F.array_contains("_status", s), F.lit(False))
    rules = [("review_rejected", has("rejected")), ("needs_review", has("needs_review")), ("label_conflict", has("rejected") & has("accepted")), ("duplicate_replacement", F.col("_n") > 1)]
    t = t.withColumn("reasons", S.reasons(*rules)).withColumn(text, F.coalesce("_text", text)).withColumn("replaced", F.col("_text").isNotNull())
    return t.withColumn("first_reason", F.get("reasons", F.lit(0))).drop("_status", "_text", "_n")


def gates(**conditions: Column) -> list[Column]:
    """Aggregates: each gate, whether all hold, and the names of those that fail."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in conditions.items()]))
    return [*[F.coalesce(c, F.lit(False)).alias(n) for n, c in conditions.items()], (F.size(failed) == 0).alias("ready"), F.array_join(failed, ",").alias("blocked")]


def locality(controls: DataFrame, key: str, expert: Column, window: int = 40) -> DataFrame:
    """Controls near the expert's one, ranked by distance in lines, then in depth, then by line."""
    center = controls.where(expert).groupBy(key).agg(F.min(F.struct("line", "depth")).alias("_at"))
    t = controls.join(center, key).withColumn("distance", F.abs(F.col("line") - F.col("_at.line")))
    w = Window.partitionBy(key).orderBy("distance", F.abs(F.col("depth") - F.col("_at.depth")), "line")
    return t.where(F.col("distance") <= window).withColumn("rank", F.row_number().over(w)).drop("_at")


def map_changes(left: DataFrame, right: DataFrame, key: str, column: str) -> DataFrame:
    """(key, name, before, after) of the map entries that differ."""
    a = left.select(key, F.explode(column).alias("name", "before"))
    b = right.select(key, F.explode(column).alias("name", "after"))
    return a.join(b, [key, "name"], "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))


def secret_keys(json: Column) -> Column:
    """Sorted names of top-level JSON fields that hold credentials."""
    keys = F.json_object_keys(json)
    return F.array_sort(F.filter(keys, lambda k: F.lower(k).rlike("(^|[_-])(" + "|".join(SECRET_KEYS) + ")($|[_-])")))


def evidence_token(kind: Column, payload: Column) -> Column:
    return F.concat(F.lit("[evidence:"), kind, F.lit(":"), F.substring(S.sha256(payload), 1, 12), F.lit("]"))


def breadth_first(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(root, node, depth): nodes within ``depth`` steps of each start, each at its least depth.

    Visited nodes are taken out by an anti-join, so cycles end; ``depth`` bounds the rounds.
    """
    found = starts.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"))
    front = found
    for k in range(1, depth + 1):
        step = front.join(edges.withColumnRenamed("u", "node"), "node").select("root", F.col("v").alias("node")).distinct()
        front = step.join(found, ["root", "node"], "left_anti").withColumn("depth", F.lit(k))
        found = found.unionByName(front)
    return found


def recompute_and_compare(stored: DataFrame, rebuilt: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Status of every cell of a stored report against its rebuilt form."""
    t = stored.select(*keys, F.col(value).alias("_s"), F.lit(True).alias("_in_s")).join(rebuilt.select(*keys, F.col(value).alias("_r"), F.lit(True).alias("_in_r")), keys, "full_outer")
    status = F.when(F.col("_in_s").isNull(), "missing").when(F.col("_in_r").isNull(), "stale").when(F.col("_s").eqNullSafe(F.col("_r")), "same").otherwise("differs")
    return t.select(*keys, status.alias("status"))
