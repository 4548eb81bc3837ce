"""Queries on ordered histories, budgets, top rows and event windows."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tallyloom.operators import sequences as Q
from tallyloom.plans.registry import query, table
from tallyloom.streaming import events as E


@query("SELECT conv_id, count(*) AS n, min(turn) AS first, max(turn) AS last, count(*) FILTER (step <> 1) AS gaps, min(turn) = 0 AND count(*) FILTER (step <> 1) = 0 AND max(turn) = count(*) - 1 AS contiguous FROM (SELECT *, turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS step FROM conversations) GROUP BY conv_id")
def conversation_continuity(spark, sf_dir):
    """WIN2, VAL19: positions run from 0 without gaps."""
    return Q.continuity(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("WITH l AS (SELECT event_id, user_id, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS delta FROM events) SELECT event_id, round(delta, 6) AS delta, CASE WHEN delta IS NULL THEN 'first' WHEN delta > 0 THEN 'up' WHEN delta < 0 THEN 'down' ELSE 'same' END AS flag FROM l")
def history_delta(spark, sf_dir):
    """WIN1, STR13: change of each step against the one before."""
    return Q.observed_delta(table(spark, sf_dir, "events"), "user_id", "event_id", "value").select("event_id", F.round("delta", 6).alias("delta"), "flag")


@query("SELECT event_id, coalesce(string_agg(event_type, '>') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING), '') AS history FROM events")
def last_k_history(spark, sf_dir):
    """WIN3, WIN4: the last nine entries before each step."""
    t = Q.last_entries(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type"), 9)
    return t.select("event_id", F.array_join("history", ">").alias("history"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS occurrence, count(*) OVER (PARTITION BY user_id, event_type) AS total FROM events")
def occurrence_numbers(spark, sf_dir):
    """WIN5, WIN6, DDP4: running number and total for each key."""
    t = table(spark, sf_dir, "events").select("event_id", F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("k"))
    return Q.occurrences(t, "k", "event_id").select("event_id", "occurrence", "total")


@query("SELECT event_id, max(value) OVER (PARTITION BY user_id) >= 90 AS success FROM events")
def trajectory_success(spark, sf_dir):
    """WIN10: the best reward decides for all steps."""
    return Q.propagate_success(table(spark, sf_dir, "events"), "user_id", "value", 90.0).select("event_id", "success")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def last_writer(spark, sf_dir):
    """WIN7, JN13: the last row of each key."""
    return Q.last_writer(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT p_brand, p_partkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 3")
def first_per_bucket(spark, sf_dir):
    """SRT9, JN6, WIN8: the first rows of each bucket."""
    t = Q.first_per_bucket(table(spark, sf_dir, "part"), "p_brand", 3, F.desc("p_retailprice"), "p_partkey")
    return t.select("p_brand", "p_partkey", "rank")


@query("""WITH a AS (SELECT p_brand, p_type, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) > 1 AS INT) AS again FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY again, p_partkey) AS rank FROM a) SELECT p_brand, p_type, p_partkey, rank FROM r WHERE rank <= 6""")
def diverse_topk(spark, sf_dir):
    """SRT5: categories first, then the rest, six for each key."""
    return Q.diverse_top(table(spark, sf_dir, "part"), "p_brand", "p_type", "p_partkey", 6).select("p_brand", "p_type", "p_partkey", "rank")


@query("""WITH p AS (SELECT page_id, url, length(html) AS size, length(html) // 1000 AS grade FROM pages), r AS (SELECT *, sum(size) OVER (ORDER BY grade, page_id ROWS UNBOUNDED PRECEDING) AS running FROM p)
SELECT page_id, size, CAST(running AS BIGINT) AS running FROM r WHERE running - size < 200000""")
def greedy_budget(spark, sf_dir):
    """WIN9: leading rows until their sizes reach a budget."""
    p = table(spark, sf_dir, "pages").select("page_id", F.length("html").cast("long").alias("size"), F.floor(F.length("html") / 1000).alias("grade"))
    return Q.greedy_budget(p, ["grade", "page_id"], "size", 200_000).select("page_id", "size", "running")


@query("SELECT CASE WHEN n <= 3 THEN '1-3' WHEN n <= 6 THEN '4-6' ELSE '7+' END AS bucket, count(*) AS conversations FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) GROUP BY 1")
def history_buckets(spark, sf_dir):
    """AGG21: lengths of histories."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return t.groupBy(F.when(F.col("n") <= 3, "1-3").when(F.col("n") <= 6, "4-6").otherwise("7+").alias("bucket")).agg(F.count("*").alias("conversations"))


@query("SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles, count(*) FILTER (role = 'system') <= 1 AND min(turn) FILTER (role = 'system') IS NOT DISTINCT FROM (CASE WHEN count(*) FILTER (role = 'system') > 0 THEN 0 END) AS well_formed FROM conversations GROUP BY conv_id")
def message_topology(spark, sf_dir):
    """VAL9, VAL12: the order of roles; a system message only at the front."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("m"))
    system = F.filter("m", lambda x: x["role"] == "system")
    ok = (F.size(system) <= 1) & ((F.size(system) == 0) | (F.get(system, F.lit(0))["turn"] == 0))
    return t.select("conv_id", F.array_join(F.transform("m", lambda x: x["role"]), ">").alias("roles"), ok.alias("well_formed"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """Extension: daily windows; the same function serves a stream."""
    t = E.windowed_counts(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return t.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 3600 THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n FROM s GROUP BY 1, 2""")
def event_sessions(spark, sf_dir):
    """Extension: sessions parted by an hour of silence."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = table(spark, sf_dir, "events").withColumn("sec", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    fresh = F.when(F.col("sec") - F.lag("sec").over(w) <= 3600, 0).otherwise(1)
    t = t.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return t.groupBy("user_id", "session").agg(F.count("*").alias("n"))


@query("SELECT event_type, CAST(user_id % 10 AS BIGINT) AS shard, count(*) AS n FROM events GROUP BY ROLLUP (event_type, user_id % 10)")
def event_rollup(spark, sf_dir):
    """Extension: totals by rollup."""
    t = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 10).alias("shard"))
    return t.rollup("event_type", "shard").agg(F.count("*").alias("n"))
