"""Queries on manifests, closures, duplicates, provenance and overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyloom.functions import scalars as S
from tallyloom.operators import integrity as I
from tallyloom.plans.registry import query, table


def _orders(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return t.withColumn("sha", S.sha256(F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderstatus", "o_orderpriority")))


@query("""WITH b AS (SELECT o_orderkey, sha256(o_custkey || '|' || o_orderstatus || '|' || o_orderpriority) AS sha FROM orders WHERE o_orderkey % 10 <> 3),
m AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE sha256(o_custkey || '|' || o_orderstatus || '|' || o_orderpriority) END AS sha FROM orders WHERE o_orderkey % 11 <> 5)
SELECT coalesce(b.o_orderkey, m.o_orderkey) AS o_orderkey, CASE WHEN m.o_orderkey IS NULL THEN 'body_only' WHEN b.o_orderkey IS NULL THEN 'manifest_only' WHEN b.sha = m.sha THEN 'ok' ELSE 'hash_mismatch' END AS status
FROM b FULL JOIN m ON b.o_orderkey = m.o_orderkey""")
def body_manifest(spark, sf_dir):
    """JN2, JN3, SET2: body against manifest, one to one."""
    t = _orders(spark, sf_dir)
    k = F.col("o_orderkey")
    manifest = t.where(k % 11 != 5).withColumn("sha", F.when(k % 7 == 0, "x").otherwise(F.col("sha")))
    return I.body_manifest(t.where(k % 10 != 3), manifest, "o_orderkey", "sha")


@query("""WITH p AS (SELECT c_custkey AS k, 1 AS p FROM customer WHERE c_custkey % 9 <> 0 UNION ALL SELECT c_custkey, 1 FROM customer WHERE c_custkey % 50 = 1),
n AS (SELECT k, count(*) AS parents FROM p GROUP BY k), c AS (SELECT o_custkey AS k, count(*) AS children FROM orders GROUP BY 1)
SELECT c.k, children, coalesce(parents, 0) AS parents, CASE WHEN parents IS NULL THEN 'missing' WHEN parents > 1 THEN 'ambiguous' ELSE 'exact' END AS status FROM c LEFT JOIN n ON c.k = n.k""")
def closure_audit(spark, sf_dir):
    """JN5, JN8, VAL7: every child has exactly one parent."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    parents = c.where("k % 9 <> 0").unionByName(c.where("k % 50 = 1"))
    return I.closure(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), parents, "k")


@query("SELECT 'customer_without_order' AS issue, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'line_without_open_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def anti_joins(spark, sf_dir):
    """JN9, AGG30: orphans on both sides, counted."""
    orders = table(spark, sf_dir, "orders")
    a = I.orphans(table(spark, sf_dir, "customer").select("c_custkey"), orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")
    b = I.orphans(table(spark, sf_dir, "lineitem").select("l_orderkey"), orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    return a.agg(F.lit("customer_without_order").alias("issue"), F.count("*").alias("n")).unionByName(b.agg(F.lit("line_without_open_order").alias("issue"), F.count("*").alias("n")))


@query("""WITH v AS (SELECT s_suppkey, variant FROM supplier CROSS JOIN (VALUES ('constraint'), ('request')) AS x(variant)),
t AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'constraint' ELSE 'request' END AS variant, s_acctbal < 0 AS truth FROM supplier WHERE s_suppkey % 5 <> 0)
SELECT v.s_suppkey, v.variant, t.truth, t.truth IS NULL AS blocked FROM v LEFT JOIN t ON v.s_suppkey = t.s_suppkey AND v.variant = t.variant""")
def variant_cross(spark, sf_dir):
    """JN4: points by variants, joined to truth, missing truth blocked."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    points = s.select("s_suppkey", F.explode(F.array(F.lit("constraint"), F.lit("request"))).alias("variant"))
    truth = s.where("s_suppkey % 5 <> 0").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, "constraint").otherwise("request").alias("variant"), (F.col("s_acctbal") < 0).alias("truth"))
    return points.join(truth, ["s_suppkey", "variant"], "left").withColumn("blocked", F.col("truth").isNull())


@query("""SELECT o_orderkey, CASE WHEN a + b + c = 0 THEN 'unassigned' WHEN a + b + c > 1 THEN 'membership_error' WHEN a = 1 THEN 'train' WHEN b = 1 THEN 'dev' ELSE 'test' END AS split
FROM (SELECT o_orderkey, CAST(o_orderkey % 3 = 0 AS INT) AS a, CAST(o_orderkey % 5 = 0 AS INT) AS b, CAST(o_orderkey % 7 = 0 AS INT) AS c FROM orders)""")
def membership(spark, sf_dir):
    """JN10, JN11: exactly one split for each id, else an error."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    t = o
    for name, n in (("train", 3), ("dev", 5), ("test", 7)):
        t = t.join(o.where(F.col("o_orderkey") % n == 0).select("o_orderkey", F.lit(1).alias(name)), "o_orderkey", "left")
    t = t.na.fill(0, ["train", "dev", "test"])
    n = F.col("train") + F.col("dev") + F.col("test")
    split = F.when(n == 0, "unassigned").when(n > 1, "membership_error").when(F.col("train") == 1, "train").when(F.col("dev") == 1, "dev").otherwise("test")
    return t.select("o_orderkey", split.alias("split"))


@query("SELECT l_orderkey, l_linenumber, o_custkey, c_nationkey, n_name, r_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE l_linenumber = 1")
def lineage_chain(spark, sf_dir):
    """JN12, JN13: the chain of parents of each sample."""
    t = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_linenumber")
    t = t.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey", "left")
    t = t.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey", "left")
    t = t.join(table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey", "left")
    t = t.join(table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey", "left")
    return t.select("l_orderkey", "l_linenumber", "o_custkey", "c_nationkey", "n_name", "r_name")


@query("""WITH j AS (SELECT a.o_orderkey, a.o_orderstatus AS s1, b.o_orderstatus AS s2, a.o_orderpriority AS p1, CASE WHEN b.o_orderkey % 4 = 0 THEN 'x' ELSE b.o_orderpriority END AS p2 FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey)
SELECT count(*) AS n, count(*) FILTER (s1 IS NOT DISTINCT FROM s2) AS status_agrees, count(*) FILTER (p1 IS NOT DISTINCT FROM p2) AS priority_agrees FROM j""")
def pinned_agreement(spark, sf_dir):
    """JN24, JN25, VAL8: agreement of pinned fields between source and derived rows."""
    o = _orders(spark, sf_dir).select("o_orderkey", "o_orderstatus", "o_orderpriority")
    d = o.select("o_orderkey", F.col("o_orderstatus").alias("s2"), F.when(F.col("o_orderkey") % 4 == 0, "x").otherwise(F.col("o_orderpriority")).alias("p2"))
    return o.join(d, "o_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus").eqNullSafe(F.col("s2"))).alias("status_agrees"), F.count_if(F.col("o_orderpriority").eqNullSafe(F.col("p2"))).alias("priority_agrees"))


@query("SELECT sha256(text) AS sha, count(*) AS copies, min(doc_id) AS first_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS aliases FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_hash(spark, sf_dir):
    """HSH1, DDP1, DDP4: physical copies with their sorted aliases."""
    t = table(spark, sf_dir, "documents").select("doc_id", S.sha256(F.col("text")).alias("sha"))
    return t.groupBy("sha").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), S.ids_text(F.col("doc_id")).alias("aliases")).where("copies > 1")


@query("SELECT lang, sha256(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY CAST(doc_id AS VARCHAR))) AS digest, count(*) AS n FROM documents GROUP BY lang")
def id_set_digest(spark, sf_dir):
    """DIG4, SNK9: digest of a sorted set of ids."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(S.id_set_digest(F.col("doc_id")).alias("digest"), F.count("*").alias("n"))


@query("SELECT doc_id, 'cand-' || substr(sha256(lang || '|' || source || '|' || n_chars), 1, 20) AS content_id FROM documents")
def content_ids(spark, sf_dir):
    """HSH3: ids from content."""
    t = table(spark, sf_dir, "documents")
    return t.select("doc_id", S.content_id("cand-", F.concat_ws("|", "lang", "source", F.col("n_chars").cast("string"))).alias("content_id"))


@query("""WITH old AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 2 = 0), new AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 = 0 THEN 'Z' ELSE o_orderstatus END AS s FROM orders)
SELECT CASE WHEN old.k IS NULL THEN 'insert' WHEN old.s = new.s THEN 'same' ELSE 'collision' END AS action, count(*) AS n FROM new LEFT JOIN old ON new.k = old.k GROUP BY 1""")
def immutable_upsert(spark, sf_dir):
    """SNK4: inserts, repeats and collisions of an append-only table."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    new = o.withColumn("s", F.when(F.col("k") % 6 == 0, "Z").otherwise(F.col("s")))
    return I.insert_only(o.where("k % 2 = 0"), new, "k", "s").groupBy("action").agg(F.count("*").alias("n"))


@query("SELECT l_suppkey, count(DISTINCT l_returnflag) AS \"values\" FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_returnflag) > 1")
def functional_dependency(spark, sf_dir):
    """DDP3, DDP5, AGG20: keys that go with more than one value."""
    return I.functional_dependency(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_returnflag")


_STATUS = "CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 'UNKNOWN' ELSE event_type END"


@query(f"WITH e AS (SELECT user_id, event_id, {_STATUS} AS status FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (status <> 'UNKNOWN') DESC, event_id DESC) AS r FROM e) SELECT user_id, status, event_id FROM r WHERE r = 1")
def latest_non_unknown(spark, sf_dir):
    """AGG27, WIN7: the latest known value of each key."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    low = e.agg(F.min("event_type")).first()[0]
    return I.latest_known(e.withColumn("status", F.when(F.col("event_type") == low, "UNKNOWN").otherwise(F.col("event_type"))), "user_id", "event_id", "status", "UNKNOWN")


@query("""WITH w AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events),
m AS (SELECT user_id, string_agg(event_type || '=' || event_id, ',' ORDER BY event_type) AS merged FROM w WHERE r = 1 GROUP BY user_id)
SELECT m.user_id, merged, count(*) AS events, max(event_id) AS last FROM m JOIN events e ON e.user_id = m.user_id GROUP BY m.user_id, merged""")
def overlay_merge(spark, sf_dir):
    """AGG28, MAP1, OVL1, STM1: payloads merged in order, later ones winning."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.create_map("event_type", F.col("event_id").cast("string")).alias("payload"))
    t = I.merge_overlays(e, "user_id", "event_id", "payload")
    return t.withColumn("merged", F.array_join(F.transform(F.map_entries("merged"), lambda x: F.concat_ws("=", x["key"], x["value"])), ","))


_CODES = """CASE WHEN l.doc_id IS NULL THEN ['missing_label'] ELSE [] END || CASE WHEN l.quality = 0 THEN ['low_quality'] ELSE [] END || CASE WHEN l.toxic = 1 THEN ['toxic'] ELSE [] END || CASE WHEN d.n_chars < 50 THEN ['too_short'] ELSE [] END"""


def _admission(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    t = d.join(table(spark, sf_dir, "labels").withColumn("there", F.lit(True)), "doc_id", "left")
    rules = [("missing_label", F.col("there").isNull()), ("low_quality", F.col("quality") == 0), ("toxic", F.col("toxic") == 1), ("too_short", F.col("n_chars") < 50)]
    return t.withColumn("reasons", S.reasons(*rules))


@query(f"SELECT d.doc_id, array_to_string({_CODES}, ',') AS reasons, len({_CODES}) = 0 AS admitted FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def admission_reasons(spark, sf_dir):
    """RTE1, JN1 in part: accepted and rejected rows with the codes of four rules over documents and labels."""
    return _admission(spark, sf_dir).select("doc_id", F.array_join("reasons", ",").alias("reasons"), (F.size("reasons") == 0).alias("admitted"))


@query(f"SELECT reason, count(*) AS n FROM (SELECT unnest({_CODES}) AS reason FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY reason")
def reason_histogram(spark, sf_dir):
    """AGG25, RTE2: how often each rule is violated."""
    return _admission(spark, sf_dir).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders), b AS (SELECT l_orderkey AS k, max(l_linestatus) AS s FROM lineitem GROUP BY 1)
SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS missing, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS extra""")
def exact_cover(spark, sf_dir):
    """SET3, SET4, SET6, JN23: multiset difference both ways."""
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_linestatus").alias("s"))
    return a.exceptAll(b).agg(F.count("*").alias("missing")).join(b.exceptAll(a).agg(F.count("*").alias("extra")))


@query("SELECT l_orderkey, count(*) AS lines, count(DISTINCT l_linenumber) AS numbers, max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS complete FROM lineitem GROUP BY l_orderkey")
def control_groups(spark, sf_dir):
    """AGG16, JN20, VAL5: every group holds the declared number of distinct members."""
    t = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.count_distinct("l_linenumber").alias("numbers"), F.max("l_linenumber").alias("top"))
    return t.select("l_orderkey", "lines", "numbers", ((F.col("top") == F.col("lines")) & (F.col("numbers") == F.col("lines"))).alias("complete"))


@query("""WITH t AS (SELECT user_id, event_type, count(*) AS steps, max(value) > 50 AS success, CAST(sum(event_id % 3) AS BIGINT) AS attempts FROM events GROUP BY 1, 2),
b AS (SELECT user_id, bool_or(success) AS recovered, CAST(sum(attempts) AS BIGINT) AS attempts FROM t GROUP BY user_id),
w AS (SELECT user_id, event_type AS solver, row_number() OVER (PARTITION BY user_id ORDER BY steps, event_type) AS r FROM t WHERE success)
SELECT b.user_id, CASE WHEN recovered THEN 'RECOVERED' ELSE 'NOT_RECOVERED_WITHIN_BUDGET' END AS status, w.solver, b.attempts FROM b LEFT JOIN w ON b.user_id = w.user_id AND w.r = 1""")
def solver_union(spark, sf_dir):
    """AGG22, DER11: any success recovers; the shortest winner, by name among equals."""
    t = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("steps"), (F.max("value") > 50).alias("success"), F.sum(F.col("event_id") % 3).alias("attempts"))
    best = F.min(F.when(F.col("success"), F.struct("steps", "event_type")))["event_type"]
    t = t.groupBy("user_id").agg(F.bool_or("success").alias("ok"), best.alias("solver"), F.sum("attempts").alias("attempts"))
    return t.select("user_id", F.when(F.col("ok"), "RECOVERED").otherwise("NOT_RECOVERED_WITHIN_BUDGET").alias("status"), "solver", "attempts")
