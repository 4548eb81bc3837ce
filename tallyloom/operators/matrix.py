"""Rater matrices, coverage and disagreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def rater_matrix(rows: DataFrame, case: str, rater: str, raters: list[str], value: str) -> DataFrame:
    """A row for each case and a column for each rater, null where a rating is missing."""
    columns = [F.max(F.when(F.col(rater) == r, F.col(value))).alias(r) for r in raters]
    return rows.groupBy(case).agg(*columns)


def coverage(rows: DataFrame, case: str, rater: str, least: int = 2) -> DataFrame:
    t = rows.groupBy(case).agg(F.count_distinct(rater).alias("raters"), F.count("*").alias("ratings"))
    return t.withColumn("under_rated", F.col("raters") < least)


def missing_cells(rows: DataFrame, case: str, rater: str) -> DataFrame:
    """Pairs of a case and a rater without a rating. Raters are a small table by design."""
    raters = F.broadcast(rows.select(rater).distinct())
    return rows.select(case).distinct().join(raters).join(rows.select(case, rater).distinct(), [case, rater], "left_anti")


def disagreement(pairs: DataFrame, left: str, right: str, unknown: str) -> DataFrame:
    """Confusion of two labels with counts, and the share of comparable pairs that differ."""
    comparable = (F.col(left) != unknown) & (F.col(right) != unknown)
    return pairs.groupBy(left, right).agg(F.count("*").alias("n")).withColumn("comparable", comparable).withColumn("disagrees", comparable & (F.col(left) != F.col(right)))
