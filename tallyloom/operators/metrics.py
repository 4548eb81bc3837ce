"""Auditable rates, classification, calibration, selective prediction and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.functions.scalars import ids_text, wilson

Rule = tuple[str, Column, Column, Column]


def rates(rows: DataFrame, by: list[str], rules: list[Rule], id_column: str, with_ids: bool = True) -> DataFrame:
    """One row for each group and metric, with numerator, denominator, bounds and ids.

    A rule is (name, denominator, numerator, observed). The rate and its Wilson interval are null
    unless every row of the denominator was observed; the partial-identification bounds count the
    unobserved rows as none and as all. One pass over the rows: metrics are conditional sums.
    """
    true = lambda c: F.coalesce(c, F.lit(False))
    parts = [F.struct(F.lit(n).alias("metric"), true(d).alias("d"), (true(d) & true(o) & true(u)).alias("u"), (true(d) & true(o)).alias("o")) for n, d, u, o in rules]
    flat = rows.select(*by, id_column, F.explode(F.array(*parts)).alias("r")).select(*by, id_column, "r.*")
    sums = [F.count_if("u").alias("numerator"), F.count_if("d").alias("denominator"), F.count_if("o").alias("observed_count")]
    if with_ids:
        sums += [ids_text(F.col(id_column), F.col("u")).alias("numerator_ids"), ids_text(F.col(id_column), F.col("d") & ~F.col("o")).alias("unknown_ids")]
    t = flat.groupBy(*by, "metric").agg(*sums)
    num, den, seen = F.col("numerator"), F.col("denominator"), F.col("observed_count")
    complete = seen == den
    some = F.nullif(den, F.lit(0))
    w = wilson(num, den)
    return t.withColumns(
        {
            "complete": complete,
            "rate": F.when(complete, num / some),
            "lower_bound": num / some,
            "upper_bound": (num + den - seen) / some,
            "observed_rate": num / F.nullif(seen, F.lit(0)),
            "wilson_low": F.when(complete, w["low"]),
            "wilson_high": F.when(complete, w["high"]),
        }
    )


def gate_small_cells(metrics: DataFrame, least: int = 30) -> DataFrame:
    """Rates of small denominators are withheld, with the reason."""
    small = F.col("denominator") < least
    return metrics.withColumns({"rate": F.when(~small, F.col("rate")), "claimable": ~small & F.col("complete"), "blocked_reason": F.when(small, F.concat(F.lit("denominator<"), F.lit(str(least))))})


def classification(rows: DataFrame, truth: str, predicted: str, classes: tuple[str, ...]) -> DataFrame:
    """Precision, recall, F1 and support of each class; rows with another truth are left out."""
    known = rows.where(F.col(truth).isin(*classes))
    spread = known.select(truth, predicted, F.explode(F.array(*[F.lit(c) for c in classes])).alias("class"))
    t, p = F.col(truth) == F.col("class"), F.coalesce(F.col(predicted) == F.col("class"), F.lit(False))
    s = spread.groupBy("class").agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(t).alias("support"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    s = s.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    both = F.col("precision") + F.col("recall")
    return s.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def calibration_bins(rows: DataFrame, probability: str, truth: str, bins: int = 10) -> DataFrame:
    """Equal bins with mean probability and event frequency; empty bins are kept."""
    index = F.least(F.lit(bins - 1), F.floor(F.col(probability) * bins)).cast("int")
    own = rows.groupBy(index.alias("bin")).agg(F.count("*").alias("n"), F.avg(probability).alias("mean_probability"), F.avg(F.col(truth).cast("double")).alias("event_frequency"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(own, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    gap = F.col("n") * F.abs(F.col("mean_probability") - F.col("event_frequency"))
    return bins.agg(F.sum("n").alias("n"), (F.sum(gap) / F.nullif(F.sum("n"), F.lit(0))).alias("ece"))


def brier(rows: DataFrame, probability: str, truth: str) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.avg(F.pow(F.col(probability) - F.col(truth).cast("double"), F.lit(2))).alias("brier"))


def risk_coverage(rows: DataFrame, probability: str, truth: str, id_column: str, coverages=(0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Error share among the most confident rows at each coverage.

    Rows are ranked by confidence with one range sort: groups of confidence are summed first, so
    only rows inside one group are ordered together.
    """
    t = rows.select(F.col(id_column).alias("id"), F.abs(F.col(probability) - 0.5).alias("sure"), ((F.col(probability) >= 0.5) != F.col(truth)).alias("wrong"))
    t = t.withColumn("level", F.floor(F.col("sure") * 4096).cast("int"))
    sizes = t.groupBy("level").agg(F.count("*").alias("n"))
    before = sizes.select("level", (F.sum("n").over(Window.orderBy(F.desc("level"))) - F.col("n")).alias("before"))  # at most 2049 rows
    ranked = t.join(F.broadcast(before), "level").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("level").orderBy(F.desc("sure"), "id")))
    total = rows.agg(F.count("*").alias("total"))
    marks = rows.sparkSession.createDataFrame([(float(c),) for c in coverages], "asked double")
    keep = marks.join(F.broadcast(total)).withColumn("n", F.ceil(F.col("total") * F.col("asked")))
    return ranked.join(F.broadcast(keep), F.col("rank") <= F.col("n")).groupBy("asked", "n", "total").agg(F.count_if("wrong").alias("errors")).select("asked", "n", (F.col("n") / F.col("total")).alias("coverage"), (F.col("errors") / F.col("n")).alias("risk"), "errors")


def flip_noise(rows: DataFrame, id_column: str, label: str, noise: float, total: int) -> DataFrame:
    """Turns the known labels of the ``round(noise * total)`` rows with the smallest SHA-256 of their id."""
    count = round(noise * total)
    digest = F.sha2(F.col(id_column).cast("string").cast("binary"), 256)
    chosen = rows.select(id_column).orderBy(digest).limit(count).select(F.col(id_column), F.lit(True).alias("_flip"))
    t = rows.join(chosen, id_column, "left")
    return t.withColumn(label, F.when(F.col("_flip"), ~F.col(label)).otherwise(F.col(label))).drop("_flip")


def draw(seed: int, *cols: Column) -> Column:
    """A whole number below 2**52 that depends on the seed and the columns alone, in every engine."""
    told = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(told.cast("binary")), 1, 13), 16, 10).cast("long")


def cluster_bootstrap(rows: DataFrame, clusters: list[str], den: Column, num: Column, iterations: int = 200, seed: int = 0) -> DataFrame:
    """Percentile interval of a rate from resampled clusters.

    Clusters are summed first, so the cost is iterations times clusters. Draws come from a hash,
    so results agree in every run; they are not those of another random generator.
    """
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in clusters])
    sums = rows.groupBy(key.alias("cluster")).agg(F.count_if(den).alias("d"), F.count_if(den & num).alias("u"))
    n = sums.count()  # a cluster each
    numbered = sums.withColumn("pos", F.row_number().over(Window.orderBy("cluster")) - 1)
    picks = rows.sparkSession.range(iterations).select(F.col("id").alias("b")).join(rows.sparkSession.range(n).select(F.col("id").alias("i")))
    picks = picks.withColumn("pos", F.pmod(draw(seed, F.col("b"), F.col("i")), F.lit(n)))
    rate = picks.join(numbered, "pos").groupBy("b").agg((F.sum("u") / F.nullif(F.sum("d"), F.lit(0))).alias("rate"))
    place = F.row_number().over(Window.orderBy("rate")) - 1
    low, high = int(0.025 * (iterations - 1)), int(0.975 * (iterations - 1))
    return rate.withColumn("k", place).agg(F.lit(n).cast("long").alias("clusters"), F.max(F.when(F.col("k") == low, F.col("rate"))).alias("low"), F.max(F.when(F.col("k") == high, F.col("rate"))).alias("high"))
