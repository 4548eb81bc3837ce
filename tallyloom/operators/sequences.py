"""Ordered-sequence operators: histories, continuity, occurrence numbers, running budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def observed_delta(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Change of each step against the one before, flagged up, down, same or first."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    change = F.col(value) - before
    flag = F.when(before.isNull(), "first").when(change > 0, "up").when(change < 0, "down").otherwise("same")
    return rows.withColumns({"delta": change, "flag": flag})


def continuity(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Per key: rows, first and last position, gaps, and whether positions run from 0 without gaps."""
    step = F.col(order) - F.lag(order).over(Window.partitionBy(key).orderBy(order))
    t = rows.select(key, order, step.alias("_step"))
    t = t.groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max(order).alias("last"), F.count_if(F.col("_step") != 1).alias("gaps"))
    return t.withColumn("contiguous", (F.col("first") == 0) & (F.col("gaps") == 0) & (F.col("last") == F.col("n") - 1))


def last_entries(rows: DataFrame, key: str, order: str, entry: Column, k: int) -> DataFrame:
    """Adds ``history``: the entries of the last ``k`` rows before this one, oldest first."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-k, -1)
    return rows.withColumn("history", F.collect_list(entry).over(w))


def occurrences(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Running number and total number of rows with the same key."""
    w = Window.partitionBy(key)
    return rows.withColumns({"occurrence": F.row_number().over(w.orderBy(order)), "total": F.count("*").over(w)})


def propagate_success(rows: DataFrame, key: str, reward: str, threshold: float) -> DataFrame:
    return rows.withColumn("success", F.max(reward).over(Window.partitionBy(key)) >= threshold)


def last_writer(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def first_per_bucket(rows: DataFrame, bucket: str, n: int, *order: str | Column) -> DataFrame:
    w = Window.partitionBy(bucket).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def diverse_top(rows: DataFrame, key: str, category: str, order: str, limit: int) -> DataFrame:
    """Up to ``limit`` rows of each key: the first row of every category, then the others, in order."""
    seen = F.row_number().over(Window.partitionBy(key, category).orderBy(order)) > 1
    t = rows.withColumn("_again", seen.cast("int"))
    w = Window.partitionBy(key).orderBy("_again", order)
    return t.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop("_again")


def greedy_budget(rows: DataFrame, order: list[str], amount: str, least: int) -> DataFrame:
    """The leading rows until their amounts reach ``least``, with the running sum.

    Sums over groups of the first order column come first, so only one group is ordered row by row.
    """
    lead = order[0]
    groups = rows.groupBy(lead).agg(F.sum(amount).alias("_sum"))
    before = groups.select(F.col(lead).alias("_lead"), (F.sum("_sum").over(Window.orderBy(lead)) - F.col("_sum")).alias("_before"))
    t = rows.join(before.where(F.col("_before") < least), F.col(lead) == F.col("_lead"))
    w = Window.partitionBy(lead).orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("running", F.col("_before") + F.sum(amount).over(w))
    return t.where(F.col("running") - F.col(amount) < least).drop("_lead", "_before")
