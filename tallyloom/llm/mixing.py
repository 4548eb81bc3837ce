"""Operator 10: mixing sources to target weights by weighted fair queueing.

Every source is shuffled by a hash and may pass twice. Each pass of a document has a virtual
finish time: the words of its source up to it, divided by the source's target. Passes are sorted
by finish time over all sources and cut where the total budget is reached. All prefix sums are
two-level (sums of bounded groups first), so no source and no total order lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyloom.session import fresh, materialize

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BUDGET_PERCENT = 150
REPEATS = 2
#: Documents that share a group of a prefix sum, about.
GROUP = 500
#: Bins of virtual time in a unit.
BINS = 65_536


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def shuffle_key(*cols: str) -> Column:
    """A uniform whole number below 2**52 from an MD5 digest, the same in every run and engine."""
    told = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in cols])
    return F.conv(F.substring(F.md5(told.cast("binary")), 1, 13), 16, 10).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """Adds ``target`` to (source, source_size, n_docs): the budget shared by weight, each share at
    most ``REPEATS`` times its source and the excess shared anew by weight among the others.

    Sources stand in code point order, null last, and weigh 3, 1, 2, repeating. The shares are
    found in closed form: in order of cap over weight, a source is capped while the level that the
    rest would get exceeds its own cap.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weigh = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    level = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    t = sources.withColumn("weight", weigh).withColumn("cap", F.col("source_size") * REPEATS)
    t = t.withColumn("budget", F.sum("source_size").over(everything) * BUDGET_PERCENT / 100.0)
    t = t.withColumn("caps_before", F.sum("cap").over(level) - F.col("cap"))
    t = t.withColumn("weight_from", F.sum("weight").over(everything) - F.sum("weight").over(level) + F.col("weight"))
    t = t.withColumn("here", (F.col("budget") - F.col("caps_before")) / F.col("weight_from"))
    t = t.withColumn("open", F.col("here") * F.col("weight") <= F.col("cap"))
    t = t.withColumn("share", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "caps_before", F.col("here")))).over(everything)["here"])
    target = F.least(F.coalesce(F.col("share") * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double"))
    return t.select("source", "source_size", "n_docs", F.col("budget"), target.alias("target"))


def mix_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, passes): how often the mix takes each document.

    Null texts have size 0; null sources form one source; documents of size 0 are taken once.
    Repeated rows count each for themselves and, being equal, stand side by side in the shuffle.
    Empty tables give empty tables. Other columns are ignored.
    """
    base = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), shuffle_key("doc_id", "source").alias("u"))
    base = materialize(base, "sizes")
    sums = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    goal = materialize(targets(sums), "targets")  # a row for each source; Spark broadcasts it if it is small
    same = F.col("b.source").eqNullSafe(F.col("g.source"))
    t = base.alias("b").join(goal.alias("g"), same).select("b.*", "g.source_size", "g.n_docs", "g.target")
    # groups of the shuffle order inside a source, of bounded size
    t = t.withColumn("group", F.floor(F.col("u") / F.lit(2.0**52) * (F.floor(F.col("n_docs") / GROUP) + 1)))
    parts = t.groupBy("source", "group").agg(F.sum("size").alias("part"))
    before = parts.select(F.col("source").alias("s"), F.col("group").alias("q"), (F.sum("part").over(Window.partitionBy("source").orderBy("group")) - F.col("part")).alias("before"))
    t = t.join(before, t.source.eqNullSafe(before.s) & (t.group == before.q)).drop("s", "q")
    inside = Window.partitionBy("source", "group").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("upto", F.col("before") + F.sum("size").over(inside))
    first = F.when(F.col("target") > 0, F.col("upto") / F.col("target"))
    again = F.when(F.col("target") > 0, (F.col("upto") + F.col("source_size")) / F.col("target"))
    t = t.select("doc_id", "source", "size", "source_size", "target", first.alias("first"), again.alias("again"))
    budget = goal.agg(F.max("budget").alias("budget")).first().budget or 0.0
    return cut(materialize(t, "finish"), budget)


def time_bin(finish: Column) -> Column:
    return F.floor(F.least(finish, F.lit(4.0)) * BINS)


def cut(t: DataFrame, budget: float) -> DataFrame:
    """Keeps the passes with the lowest finish times while their words stay within the budget.

    Sums over fixed bins of time find the bin in which the budget ends; only that one is sorted.
    Three numbers go through the driver.
    """
    passes = t.select("size", F.explode(F.array("first", "again")).alias("finish")).where("finish is not null and size > 0")
    passes = passes.withColumn("bin", time_bin(F.col("finish")))
    bins = passes.groupBy("bin").agg(F.sum("size").alias("words"))
    bins = bins.withColumn("upto", F.sum("words").over(Window.orderBy("bin")))  # at most 4 * BINS rows
    edge = bins.agg(F.min(F.when(F.col("upto") > budget, F.col("bin"))).alias("bin"), F.max(F.when(F.col("upto") <= budget, F.col("upto"))).alias("sure")).first()
    last = edge.bin if edge.bin is not None else 4 * BINS + 1
    run = F.lit(edge.sure or 0) + F.sum("size").over(Window.orderBy("finish").rangeBetween(Window.unboundedPreceding, 0))
    time = passes.where(F.col("bin") == last).withColumn("run", run).where(F.col("run") <= budget).agg(F.max("finish").alias("time")).first().time
    end = F.lit(-1.0 if time is None else time)
    taken = lambda c: F.when((time_bin(F.col(c)) < last) | (F.col(c) <= end), 1).otherwise(0)
    times = F.when(F.col("size") == 0, 1).otherwise(taken("first") + taken("again"))
    return t.select("doc_id", "source", "size", "source_size", "target", times.alias("passes"))


def mix(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it: 0, 1 or 2 times.

    Rows without words are taken once. Rows that agree in doc_id, source and size get the highest
    count of them all; null ids and null sources agree with each other. Very long texts only count
    their words. An empty table stays empty; extra columns of any name come back unchanged.
    """
    size, passes, turn = fresh(docs.columns, "size", "passes", "turn")
    counts = mix_counts(docs).groupBy("doc_id", "source", "size").agg(F.max("passes").alias("passes")).where("passes > 0")
    # a row for each document: joined by a shuffle at every size
    p = materialize(counts, "passes").hint("merge").select(F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"), F.col("size").alias("p_size"), F.col("passes").alias("p_passes")).alias("p")
    d = docs.withColumn(size, word_count(F.col("text"))).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("p.p_id")) & F.col("d.source").eqNullSafe(F.col("p.p_source")) & (F.col(f"d.{size}") == F.col("p.p_size"))
    taken = d.join(p, same).select("d.*", F.col("p.p_passes").alias(passes)).withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(passes))))
    return taken.select(*docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents."""
    t = mix_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return t.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("passes")).alias("taken"))


ORACLE = r"""
WITH base AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || coalesce(source, '-')), 1, 13) AS BIGINT) AS u
  FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
weighed AS (
  SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, source_size * 2 AS cap,
         sum(source_size) OVER () * 150 / 100.0 AS budget FROM sums),
levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER before, 0)) / sum(w) OVER rest AS here FROM weighed
  WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         rest AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
goals AS (
  SELECT source, source_size, budget, least(coalesce(w * arg_min(here, cap / w) FILTER (here * w <= cap) OVER (), cap), cap) :: DOUBLE AS target
  FROM levels),
timed AS (
  SELECT b.doc_id, b.size, b.u, g.source_size, g.target, g.budget,
         sum(b.size) OVER (PARTITION BY b.source ORDER BY b.u, b.doc_id, b.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM base b JOIN goals g ON b.source IS NOT DISTINCT FROM g.source),
passes AS (
  SELECT doc_id, u, size, budget, (upto + k * source_size) / target AS finish
  FROM timed, (VALUES (0), (1)) AS v(k) WHERE target > 0 AND size > 0),
summed AS (SELECT *, sum(size) OVER (ORDER BY finish RANGE UNBOUNDED PRECEDING) AS run FROM passes),
won AS (SELECT doc_id, sum(size) AS taken FROM summed WHERE run <= budget GROUP BY doc_id)
SELECT t.doc_id, t.size, t.source_size, t.target, CAST(coalesce(w.taken, 0) AS BIGINT) AS taken
FROM timed t LEFT JOIN won w ON t.doc_id = w.doc_id
"""
