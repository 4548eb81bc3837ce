"""Queries on release views, gates and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import scalars as S
from tallyloom.operators import release as R
from tallyloom.plans.registry import query, table


@query("""WITH d AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 0 THEN 'needs_review' ELSE 'accepted' END AS status FROM labels UNION ALL SELECT doc_id, 'accepted' FROM labels WHERE doc_id % 3 = 0),
s AS (SELECT doc_id, bool_or(status = 'rejected') AS r, bool_or(status = 'needs_review') AS n, bool_or(status = 'accepted') AS a FROM d GROUP BY doc_id)
SELECT x.doc_id, x.doc_id % 10 = 0 AS replaced, CASE WHEN x.doc_id % 10 = 0 THEN 'new ' || x.lang ELSE x.lang END AS lang,
  CASE WHEN r THEN 'review_rejected' WHEN n THEN 'needs_review' WHEN x.doc_id % 30 = 0 THEN 'duplicate_replacement' END AS first_reason,
  array_to_string(CASE WHEN r THEN ['review_rejected'] ELSE [] END || CASE WHEN n THEN ['needs_review'] ELSE [] END || CASE WHEN r AND a THEN ['label_conflict'] ELSE [] END || CASE WHEN x.doc_id % 30 = 0 THEN ['duplicate_replacement'] ELSE [] END, ',') AS reasons
FROM documents x LEFT JOIN s ON x.doc_id = s.doc_id""")
def export_overlay(spark, sf_dir):
    """OVL1, SNK6, PRJ24: overlays with exclusion reasons."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels")
    status = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 0, "needs_review").otherwise("accepted")
    decisions = labels.select("doc_id", status.alias("status")).unionByName(labels.where("doc_id % 3 = 0").select("doc_id", F.lit("accepted").alias("status")))
    new = docs.where("doc_id % 10 = 0").select("doc_id", F.concat(F.lit("new "), "lang").alias("lang"))
    t = R.export_overlay(docs, "doc_id", decisions, new.unionByName(new.where("doc_id % 30 = 0")), "lang")
    return t.select("doc_id", "replaced", "lang", "first_reason", F.array_join("reasons", ",").alias("reasons"))


@query("""WITH a AS (SELECT count(*) >= 100 AS enough, count(DISTINCT doc_id) = count(*) AS unique_ids, count(*) FILTER (lang IS NULL) = 0 AS no_missing, count(DISTINCT lang) >= 5 AS languages FROM documents)
SELECT *, enough AND unique_ids AND no_missing AND languages AS ready, array_to_string(CASE WHEN enough THEN [] ELSE ['enough'] END || CASE WHEN unique_ids THEN [] ELSE ['unique_ids'] END || CASE WHEN no_missing THEN [] ELSE ['no_missing'] END || CASE WHEN languages THEN [] ELSE ['languages'] END, ',') AS blocked FROM a""")
def release_gates(spark, sf_dir):
    """AGG29, GRF11, SRC8: gates with the names of those that fail."""
    t = table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.count("*").alias("n"), F.count("lang").alias("l"), F.min("lang").alias("lang"))
    t = t.agg(F.sum("n").alias("rows"), F.count("*").alias("ids"), F.sum("l").alias("told"), F.count_distinct("lang").alias("langs"))
    c = F.col
    return t.select(*R.gates(enough=c("rows") >= 100, unique_ids=c("rows") == c("ids"), no_missing=c("rows") == c("told"), languages=c("langs") >= 5))


@query("""SELECT d.lang, count(*) AS n, count(l.doc_id) AS labelled, round(avg(d.n_chars), 6) AS mean_chars, round(avg(l.quality), 6) AS quality, count(*) FILTER (l.toxic = 1) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang""")
def quality_report(spark, sf_dir):
    """AGG12, AGG13, AGG33, VEW1: volumes and rates of the release."""
    t = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels").withColumn("there", F.lit(1)), "doc_id", "left")
    return t.groupBy("lang").agg(F.count("*").alias("n"), F.count("there").alias("labelled"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.round(F.avg("quality"), 6).alias("quality"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@query("""WITH x AS (SELECT l_orderkey AS k, l_linenumber AS line, l_linenumber % 3 AS depth FROM lineitem), c AS (SELECT k, min(line) AS mid FROM x WHERE line = 2 GROUP BY k)
SELECT x.k, x.line, row_number() OVER (PARTITION BY x.k ORDER BY abs(line - mid), abs(depth - 2), line) AS rank FROM x JOIN c ON x.k = c.k WHERE abs(line - mid) <= 2""")
def locality_ranking(spark, sf_dir):
    """SRT4: rows near a chosen one, ranked by distance."""
    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), (F.col("l_linenumber") % 3).alias("depth"))
    return R.locality(x, "k", F.col("line") == 2, 2).select("k", "line", "rank")


@query("""WITH a AS (SELECT user_id, event_type AS name, max(event_id) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), b AS (SELECT user_id, event_type AS name, max(event_id) AS v FROM events WHERE event_id % 3 <> 0 GROUP BY 1, 2)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.name, b.name) AS name, a.v AS before, b.v AS after FROM a FULL JOIN b ON a.user_id = b.user_id AND a.name = b.name WHERE a.v IS DISTINCT FROM b.v""")
def map_changes(spark, sf_dir):
    """STR22, MAP1: entries that differ between two maps."""
    e = table(spark, sf_dir, "events")
    of = lambda t: t.groupBy("user_id", "event_type").agg(F.max("event_id").alias("v")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))
    return R.map_changes(of(e.where("event_id % 2 = 0")), of(e.where("event_id % 3 <> 0")), "user_id", "m")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'api_key,my-token' WHEN 1 THEN '' ELSE 'Cookie' END AS keys FROM events")
def secret_keys(spark, sf_dir):
    """SEC1: names of fields that hold credentials."""
    k = F.col("event_id") % 3
    json = F.when(k == 0, '{"my-token": 1, "api_key": "x", "n": 2}').when(k == 1, '{"tokens": 1}').otherwise('{"Cookie": null}')
    return table(spark, sf_dir, "events").select("event_id", F.array_join(R.secret_keys(json), ",").alias("keys"))


@query("SELECT item_id, '[evidence:probe:' || substr(sha256(text), 1, 12) || ']' AS token FROM benchmark")
def evidence_tokens(spark, sf_dir):
    """HSH5, DER8: tokens that name their evidence by its digest."""
    return table(spark, sf_dir, "benchmark").select("item_id", R.evidence_token(F.lit("probe"), F.col("text")).alias("token"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS u, o_custkey * 7 % 1500 + 1 AS v FROM orders UNION SELECT DISTINCT o_custkey, o_custkey * 3 % 1500 + 1 FROM orders),
w(root, node, depth) AS (SELECT c_custkey, c_custkey, 0 FROM customer WHERE c_custkey % 100 = 0 UNION SELECT root, v, depth + 1 FROM w JOIN e ON node = u WHERE depth < 3)
SELECT root, node, min(depth) AS depth FROM w GROUP BY root, node""")
def bounded_search(spark, sf_dir):
    """Breadth-first search to a fixed depth."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("u")).distinct()
    edges = o.select("u", (F.col("u") * 7 % 1500 + 1).alias("v")).union(o.select("u", (F.col("u") * 3 % 1500 + 1).alias("v")))
    starts = table(spark, sf_dir, "customer").where("c_custkey % 100 = 0").select(F.col("c_custkey").alias("node"))
    return R.breadth_first(edges, starts, 3)


@query()
def whole_search(spark, sf_dir):
    """Breadth-first search to a fixed depth from every customer, with edges over all keys."""
    customers = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("u")).distinct()
    o = o.crossJoin(F.broadcast(customers.agg(F.max("c_custkey").alias("top"))))  # one row
    edges = o.select("u", (F.col("u") * 7 % F.col("top") + 1).alias("v")).union(o.select("u", (F.col("u") * 3 % F.col("top") + 1).alias("v")))
    return R.breadth_first(edges, customers.select(F.col("c_custkey").alias("node")), 3)


@query("""WITH a AS (SELECT lang, source, count(*) AS n FROM documents WHERE doc_id % 100 <> 7 GROUP BY 1, 2), b AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT coalesce(a.lang, b.lang) AS lang, coalesce(a.source, b.source) AS source, CASE WHEN a.n IS NULL THEN 'missing' WHEN b.n IS NULL THEN 'stale' WHEN a.n = b.n THEN 'same' ELSE 'differs' END AS status FROM a FULL JOIN b ON a.lang = b.lang AND a.source = b.source""")
def recompute_compare(spark, sf_dir):
    """AUD5, AUD2: a stored report against its rebuilt form."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    count = lambda t: t.groupBy("lang", "source").agg(F.count("*").alias("n"))
    return R.recompute_and_compare(count(d.where("doc_id % 100 <> 7")), count(d), ["lang", "source"], "n")


@query("""SELECT doc_id, coalesce(nullif(lang, 'en'), source) AS entity, lang || ':' || source AS template, split_part(source, 'c', 2) AS tail FROM documents""")
def split_axes(spark, sf_dir):
    """PRJ17, PRJ15, PRJ7: axes by chains of fallbacks."""
    t = table(spark, sf_dir, "documents")
    return t.select("doc_id", F.coalesce(F.nullif("lang", F.lit("en")), "source").alias("entity"), F.concat_ws(":", "lang", "source").alias("template"), F.split_part("source", F.lit("c"), F.lit(2)).alias("tail"))


@query("""SELECT o_orderkey, array_to_string(CASE WHEN o_totalprice IS NULL THEN ['no_price'] ELSE [] END || CASE WHEN o_orderstatus = 'P' THEN ['open'] ELSE [] END || CASE WHEN date_part('month', o_orderdate) = 12 THEN ['late'] ELSE [] END, ',') AS codes FROM orders""")
def reason_codes(spark, sf_dir):
    """Three row-local rules on orders as codes."""
    t = table(spark, sf_dir, "orders")
    rules = [("no_price", F.col("o_totalprice").isNull()), ("open", F.col("o_orderstatus") == "P"), ("late", F.month("o_orderdate") == 12)]
    return t.select("o_orderkey", F.array_join(S.reasons(*rules), ",").alias("codes"))
