"""Queries of evidence joins and derived views; tables of the store stand for records of the same shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import evidence as E
from tallyloom.plans.registry import derived, in_duckdb, query, table

NEGATIVES = """SELECT event_id AS error_id, event_id % 700 AS sample_id, CASE WHEN event_id % 3 > 0 THEN event_id % 450 END AS candidate_id, CASE WHEN event_id % 4 = 0 THEN 'on_policy' ELSE 'legal' END AS source, CASE WHEN event_id % 8 < 7 THEN user_id END AS trace_id, 'h' || CAST(user_id % 40 AS STRING) AS completion_hash FROM {events}"""
SAMPLES = """SELECT doc_id AS sample_id, doc_id % 9 AS state_id, doc_id % 10 > 0 AS formal, CASE WHEN doc_id % 11 = 0 THEN 'user,assistant' ELSE 'system,user,assistant' END AS topology FROM {documents}"""
OPTIONS = """SELECT doc_id AS candidate_id, doc_id % 9 AS state_id, toxic = 0 AS legal FROM {labels}"""
TRACES = """SELECT c_custkey AS trace_id, c_custkey % 700 AS sample_id, 'h' || CAST(c_custkey % 40 AS STRING) AS completion_hash, c_custkey % 5 > 0 AS eligible FROM {customer}"""
_ALL = f"WITH n AS ({in_duckdb(NEGATIVES, 'events')}), s AS ({in_duckdb(SAMPLES, 'documents')}), o AS ({in_duckdb(OPTIONS, 'labels')}), t AS ({in_duckdb(TRACES, 'customer')})"


@query(f"""{_ALL}, s1 AS (SELECT sample_id, count(*) AS n, min(state_id) AS state_id, bool_and(formal) AS formal, min(topology) AS topology FROM s GROUP BY sample_id), o1 AS (SELECT candidate_id, count(*) AS n, min(state_id) AS state_id, bool_and(legal) AS legal FROM o GROUP BY candidate_id),
t1 AS (SELECT trace_id, count(*) AS n, min(sample_id) AS sample_id, min(completion_hash) AS h, bool_and(eligible) AS eligible FROM t GROUP BY trace_id)
SELECT error_id, concat_ws(',', CASE WHEN s1.n IS NULL THEN 'unknown_sample' WHEN s1.n > 1 THEN 'sample_repeats' END, CASE WHEN s1.n = 1 AND NOT formal THEN 'sample_not_formal' END, CASE WHEN s1.n = 1 AND topology <> 'system,user,assistant' THEN 'topology' END,
  CASE WHEN n.candidate_id IS NOT NULL AND o1.n IS NULL THEN 'unknown_candidate' END, CASE WHEN o1.n = 1 AND s1.n = 1 AND o1.state_id <> s1.state_id THEN 'candidate_state' END, CASE WHEN o1.n = 1 AND NOT legal THEN 'candidate_illegal' END,
  CASE WHEN source = 'on_policy' AND t1.n IS DISTINCT FROM 1 THEN 'trace_missing' END, CASE WHEN source = 'on_policy' AND t1.n = 1 AND t1.sample_id <> n.sample_id THEN 'trace_sample' END, CASE WHEN source = 'on_policy' AND t1.n = 1 AND t1.h <> n.completion_hash THEN 'trace_hash' END, CASE WHEN source = 'on_policy' AND t1.n = 1 AND NOT eligible THEN 'trace_not_eligible' END) AS reasons
FROM n LEFT JOIN s1 ON n.sample_id = s1.sample_id LEFT JOIN o1 ON n.candidate_id = o1.candidate_id LEFT JOIN t1 ON n.trace_id = t1.trace_id""")
def negative_pairs(spark, sf_dir):
    """JN7: audited negatives against sample, candidate and trace, with a reason for each that fails."""
    t = E.negative_pairs(derived(spark, sf_dir, NEGATIVES, "events"), derived(spark, sf_dir, SAMPLES, "documents"), derived(spark, sf_dir, OPTIONS, "labels"), derived(spark, sf_dir, TRACES, "customer"))
    return t.select("error_id", F.array_join("reasons", ",").alias("reasons"))


CASES = """SELECT o_orderkey AS row, CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'c' || CAST(o_orderkey - o_orderkey % 11 % 2 AS STRING) END AS case_id, 'p' || CAST(o_custkey % 30 AS STRING) AS point_id, o_orderstatus AS effect, o_orderpriority AS decision FROM {orders}"""
CASE_TRUTHS = """SELECT 'c' || CAST(o_orderkey AS STRING) AS case_id, 'p' || CAST((o_custkey + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) % 30 AS STRING) AS point_id, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS effect, CASE WHEN o_orderkey % 6 > 0 THEN o_orderpriority END AS decision FROM {orders} WHERE o_orderkey % 9 > 0"""
CASE_POINTS = """SELECT 'p' || CAST(s_suppkey % 29 AS STRING) AS point_id FROM {supplier}"""


@query(f"""WITH r AS ({in_duckdb(CASES, 'orders')}), t AS ({in_duckdb(CASE_TRUTHS, 'orders')}), p AS (SELECT DISTINCT point_id FROM ({in_duckdb(CASE_POINTS, 'supplier')})), x AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY row) AS turn, coalesce(case_id, '') <> '' AS named FROM r),
t1 AS (SELECT case_id, count(*) AS n, min(point_id) AS point_id, min(effect) AS effect, min(decision) AS decision FROM t GROUP BY case_id)
SELECT row, concat_ws(',', CASE WHEN NOT named THEN 'missing_case' END, CASE WHEN named AND turn > 1 THEN 'repeated_case' END, CASE WHEN named AND turn = 1 AND t1.n IS DISTINCT FROM 1 THEN 'unknown_case' END, CASE WHEN named AND turn = 1 AND t1.n = 1 AND p.point_id IS NULL THEN 'unknown_point' END,
  {', '.join(f"CASE WHEN named AND turn = 1 AND t1.n = 1 AND x.{c} IS DISTINCT FROM t1.{c} THEN 'differs:{c}' END" for c in ('point_id', 'effect', 'decision'))}) AS reasons FROM x LEFT JOIN t1 ON x.case_id = t1.case_id LEFT JOIN p ON p.point_id = t1.point_id""")
def episode_lineage(spark, sf_dir):
    """JN18: episodes against truth and point, by case, with the fields that differ."""
    t = E.episode_lineage(derived(spark, sf_dir, CASES, "orders"), derived(spark, sf_dir, CASE_TRUTHS, "orders"), derived(spark, sf_dir, CASE_POINTS, "supplier"), ["effect", "decision"])
    return t.select("row", F.array_join("reasons", ",").alias("reasons"))


SHOTS = """SELECT CASE WHEN p_partkey % 10 > 0 THEN 's' || CAST(p_partkey % 100 AS STRING) END AS state_id, CASE WHEN p_partkey % 11 > 0 THEN '[' || CAST(p_partkey % 7 AS STRING) || '] button ''Go''' || chr(10) || ' [9] link ''' || p_brand || '''' END AS snapshot FROM {part}"""


@query(f"""WITH x AS ({in_duckdb(SHOTS, 'part')}), c AS (SELECT p_partkey, 's' || (p_partkey % 100) AS state_id, sha256('[' || (p_partkey % 7) || '] button ''Go''' || chr(10) || ' [9] link ''' || p_brand || '''') AS h, (p_partkey + p_size) % 8 AS bid FROM part),
h AS (SELECT state_id, sha256(snapshot) AS h, count(DISTINCT snapshot) AS n, min(snapshot) AS snapshot FROM x WHERE state_id <> '' AND snapshot <> '' GROUP BY 1, 2)
SELECT p_partkey AS candidate_id, CASE WHEN h.n IS NULL THEN 'missing_snapshot' WHEN n > 1 THEN 'colliding_snapshot' WHEN contains(snapshot, '[' || bid || '] ') THEN 'ok' ELSE 'absent_bid' END AS status FROM c LEFT JOIN h ON c.state_id = h.state_id AND c.h = h.h""")
def candidate_snapshots(spark, sf_dir):
    """JN19: candidates against the snapshot of their state and hash."""
    raw = "'[' || CAST(p_partkey % 7 AS STRING) || '] button ''Go''' || chr(10) || ' [9] link ''' || p_brand || ''''"
    c = derived(spark, sf_dir, f"SELECT p_partkey AS candidate_id, 's' || CAST(p_partkey % 100 AS STRING) AS state_id, sha2(CAST({raw} AS BINARY), 256) AS snapshot_hash, CAST((p_partkey + p_size) % 8 AS STRING) AS bid FROM {{part}}", "part")
    return E.snapshot_status(c, derived(spark, sf_dir, SHOTS, "part"))


REFS = """SELECT o_orderkey AS row, CASE WHEN o_orderkey % 6 > 0 THEN o_custkey * 3 % 200 END AS transition_id, o_custkey % 10 AS state_id, CAST(o_orderkey % 3 AS STRING) AS record_hash FROM {orders}"""
MOVES = """SELECT s_suppkey AS transition_id, s_suppkey % 10 AS state_id, CAST(s_nationkey % 3 AS STRING) AS record_hash FROM {supplier}"""


@query(f"""WITH r AS ({in_duckdb(REFS, 'orders')}), m AS ({in_duckdb(MOVES, 'supplier')}) SELECT row, concat_ws(',', CASE WHEN r.transition_id IS NULL THEN 'missing_ref' END, CASE WHEN r.transition_id IS NOT NULL AND m.transition_id IS NULL THEN 'unknown_transition' END,
  CASE WHEN m.transition_id IS NOT NULL AND r.state_id <> m.state_id THEN 'state_differs' END, CASE WHEN m.transition_id IS NOT NULL AND r.record_hash <> m.record_hash THEN 'hash_differs' END) AS reasons FROM r LEFT JOIN m ON r.transition_id = m.transition_id""")
def transition_refs(spark, sf_dir):
    """JN16: training rows against the transitions they name."""
    return E.transition_refs(derived(spark, sf_dir, REFS, "orders"), derived(spark, sf_dir, MOVES, "supplier")).select("row", F.array_join("reasons", ",").alias("reasons"))


@query("""WITH v AS (SELECT c_custkey AS state_id, c_name AS url FROM customer WHERE c_custkey % 3 = 0), c AS (SELECT DISTINCT o_custkey AS state_id FROM orders), k AS (SELECT c_custkey AS state_id, min(c_mktsegment) AS k FROM customer WHERE c_custkey % 3 = 1 GROUP BY 1), p AS (SELECT c_custkey AS state_id, min(c_name) AS p FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1)
SELECT state_id, url, 'view' AS origin FROM v UNION ALL SELECT c.state_id, coalesce(k, p), CASE WHEN k IS NOT NULL THEN 'key_state' WHEN p IS NOT NULL THEN 'point' ELSE 'nowhere' END FROM c LEFT JOIN k ON c.state_id = k.state_id LEFT JOIN p ON c.state_id = p.state_id WHERE c.state_id NOT IN (SELECT state_id FROM v)""")
def reached_states(spark, sf_dir):
    """JN14: a derived view with states that it lacks filled from key states, then points."""
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "state_id")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("state_id"))
    return E.reached_states(c.where("state_id % 3 = 0").withColumnRenamed("c_name", "url"), orders, c.where("state_id % 3 = 1").withColumnRenamed("c_mktsegment", "url"), c.where("state_id % 2 = 0").withColumnRenamed("c_name", "url"))


@query("""SELECT 'doc' || (event_id % 900) || '__' || event_type AS pair_id, 'doc' || doc_id AS sample_id, lang FROM events JOIN documents ON event_id % 900 = doc_id WHERE event_id % 5 > 0""")
def pairs_of_samples(spark, sf_dir):
    """JN27: pairs with the sample that their id begins with, by a derived key."""
    k = F.col("event_id")
    pairs = table(spark, sf_dir, "events").select(F.concat(F.lit("doc"), (k % 900).cast("string"), F.when(k % 5 > 0, "__").otherwise("-"), "event_type").alias("pair_id"))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("sample_id"), "lang")
    return E.pairs_of_samples(pairs, docs).select("pair_id", "sample_id", "lang")


@query("""SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE event_id % 4 > 0 AND (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE event_id % 40 = 0) GROUP BY user_id, event_type""")
def unseen_states(spark, sf_dir):
    """DDP2: the first row of each key that no earlier batch has."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return E.unseen(e.where("event_id % 4 > 0"), e.where("event_id % 40 = 0"), ["user_id", "event_type"], "event_id")


@query("""WITH m AS (SELECT DISTINCT lang AS split, length(text) % 97 AS id FROM documents), b AS (SELECT x.split AS a, y.split AS b, x.id, row_number() OVER (PARTITION BY x.split, y.split ORDER BY x.id) AS turn FROM m x JOIN m y ON x.id = y.id AND x.split < y.split)
SELECT a, b, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (turn <= 10) AS first_ids FROM b GROUP BY a, b""")
def membership_overlap(spark, sf_dir):
    """SET9, SRT6: ids that two splits share, the first ten shown."""
    return E.membership_overlap(table(spark, sf_dir, "documents").select(F.col("lang").alias("split"), (F.length("text") % 97).alias("id")))


@query("""WITH s AS (SELECT l_orderkey AS t, l_linenumber - 1 AS at, min(l_returnflag) AS action FROM lineitem WHERE l_linenumber % 5 > 0 GROUP BY 1, 2), k AS (SELECT o_orderkey AS state_id, o_orderkey AS t, o_custkey % 6 AS step_id FROM orders)
SELECT state_id, count(s.at) AS n_history, arg_max(s.action, s.at) AS last_action, CASE WHEN count(s.at) = step_id THEN 'aligned' WHEN count(s.at) = 0 THEN 'none' ELSE 'gap' END AS alignment FROM k LEFT JOIN s ON k.t = s.t AND s.at < step_id GROUP BY state_id, step_id""")
def prefix_history(spark, sf_dir):
    """DER5: what a trajectory did before a state's step, and whether steps lack."""
    steps = table(spark, sf_dir, "lineitem").where("l_linenumber % 5 > 0").groupBy(F.col("l_orderkey").alias("trajectory_id"), (F.col("l_linenumber") - 1).alias("step_id")).agg(F.min("l_returnflag").alias("action"))
    states = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("state_id"), F.col("o_orderkey").alias("trajectory_id"), (F.col("o_custkey") % 6).alias("step_id"))
    return E.prefix_history(steps, states)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'ran' WHEN o_orderkey % 4 = 0 THEN o_orderpriority WHEN o_orderkey % 5 > 0 THEN 'open' ELSE '' END AS history, CASE WHEN o_orderkey % 3 = 0 THEN 'trajectory' WHEN o_orderkey % 4 = 0 THEN 'plan' WHEN o_orderkey % 5 > 0 THEN 'canonical' ELSE 'none' END AS source FROM orders""")
def history_sources(spark, sf_dir):
    """DER13: histories from trajectory, plan or rule, whichever is there first."""
    k = F.col("o_orderkey")
    x = E.history_source(F.when(k % 3 == 0, "ran").otherwise(F.lit("")), F.when(k % 4 == 0, F.col("o_orderpriority")), F.when(k % 5 > 0, "open"))
    return table(spark, sf_dir, "orders").select("o_orderkey", x.alias("x")).select("o_orderkey", "x.*")


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 > 0 THEN role ELSE 'm' || conv_id END AS model, CASE WHEN turn % 4 = 0 THEN 'v' || conv_id ELSE 'v' || turn END AS version, turn % 7 > 0 AS hash_holds, substr(sha256('s' || conv_id || chr(0) || 't' || turn), 1, 20) AS negative_id FROM conversations""")
def trace_values(spark, sf_dir):
    """DER3, DER4: values of a step, else of its episode; hashes of completions verified; ids of negatives from sample and trace."""
    t = table(spark, sf_dir, "conversations")
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    steps = t.select(F.col("conv_id").alias("episode_id"), "turn", F.col("text").alias("completion"), F.when(F.col("turn") % 7 > 0, digest).otherwise("x").alias("completion_hash"), F.when(F.col("turn") % 3 > 0, F.col("role")).alias("model"), F.when(F.col("turn") % 4 > 0, F.concat(F.lit("v"), F.col("turn").cast("string"))).alias("version"))
    text = F.col("conv_id").cast("string")
    episodes = t.select("conv_id").distinct().select(F.col("conv_id").alias("episode_id"), F.concat(F.lit("m"), text).alias("model"), F.concat(F.lit("v"), text).alias("version"))
    made = E.negative_id(F.concat(F.lit("s"), F.col("episode_id").cast("string")), F.concat(F.lit("t"), F.col("turn").cast("string")))
    return E.trace_values(steps, episodes, ["model", "version"]).select(F.col("episode_id").alias("conv_id"), "turn", "model", "version", "hash_holds", made.alias("negative_id"))


@query("SELECT times, count(*) AS ids FROM (SELECT user_id, count(*) AS times FROM events GROUP BY user_id) GROUP BY times")
def id_multiplicity(spark, sf_dir):
    """AGG26: how often ids stand in a table."""
    return E.multiplicity(table(spark, sf_dir, "events"), "user_id")


@query("SELECT event_type, count(*) AS n, count(DISTINCT (user_id, props)) AS snapshots, count(DISTINCT user_id) AS states, count(DISTINCT CAST(ts AS DATE)) AS runs FROM events GROUP BY event_type")
def census_report(spark, sf_dir):
    """AGG15: distinct snapshots, states and runs of a census."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct(F.struct("user_id", "props")).alias("snapshots"), F.count_distinct("user_id").alias("states"), F.count_distinct(F.to_date("ts")).alias("runs"))


_Z = 1.959963984540054
_LOW = f"CASE WHEN {{0}} + {{1}} = 0 THEN 0 ELSE greatest(0, ({{0}} / ({{0}} + {{1}}) + {_Z * _Z} / (2 * ({{0}} + {{1}})) - {_Z} * sqrt(({{0}} / ({{0}} + {{1}}) * (1 - {{0}} / ({{0}} + {{1}})) + {_Z * _Z} / (4 * ({{0}} + {{1}}))) / ({{0}} + {{1}}))) / (1 + {_Z * _Z} / ({{0}} + {{1}}))) END"


@query(f"""WITH n AS (SELECT event_type, count(*) FILTER (value > 50 AND event_id % 3 = 0) AS tp, count(*) FILTER (value > 50 AND event_id % 3 <> 0) AS fp, count(*) FILTER (value <= 50 AND event_id % 3 = 0) AS fn, count(*) FILTER (value <= 50 AND event_id % 3 <> 0) AS tn FROM events GROUP BY event_type)
SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, {_LOW.format('tp', 'fp')} AS precision_low, {_LOW.format('tp', 'fn')} AS recall_low FROM n""")
def detection_report(spark, sf_dir):
    """AGG14, STAT2, MIN1: detected changes of recorded trials against the truth."""
    t = table(spark, sf_dir, "events").select("event_type", (F.col("value") > 50).alias("detected"), (F.col("event_id") % 3 == 0).alias("truth"))
    return E.detection_report(t, "event_type")


@query("""WITH r AS (SELECT lang AS truth, CASE doc_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN lang WHEN 2 THEN 'de' END AS said FROM documents WHERE lang IN ('en', 'de', 'fr', 'xx')), c AS (SELECT unnest(['en', 'de', 'fr', 'xx']) AS class),
n AS (SELECT class, count(*) FILTER (truth = class AND said = class) AS tp, count(*) FILTER (said = class) AS said, count(*) FILTER (truth = class) AS support FROM r, c GROUP BY class), f AS (SELECT class, support, tp / nullif(said, 0) AS precision, tp / nullif(support, 0) AS recall, CASE WHEN support > 0 THEN 2 * tp / (said + support) END AS f1 FROM n)
SELECT *, avg(f1) OVER () AS macro_f1 FROM f""")
def class_scores(spark, sf_dir):
    """AGG4: scores by class and their mean over the classes that occur."""
    k = F.col("doc_id") % 4
    t = table(spark, sf_dir, "documents").select("lang", F.when(k == 0, "en").when(k == 1, F.col("lang")).when(k == 2, "de").alias("said"))
    return E.class_scores(t, "lang", "said", ["en", "de", "fr", "xx"])


_MOD = "list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 41), lambda i: CAST(instr('0123456789abcdef', substr(sha1(CAST({0} AS VARCHAR)), i, 1)) - 1 AS BIGINT))), lambda a, b: (a * 16 + b) % {1})"


@query(f"""WITH h AS (SELECT DISTINCT c_nationkey AS k, {_MOD.format('c_nationkey', 10)} = 0 AS held FROM customer), f AS (SELECT bool_or(held) AND NOT bool_and(held) AS fits FROM h) SELECT c_custkey, CASE WHEN fits AND held THEN 'validation' ELSE 'train' END AS part FROM customer JOIN h ON c_nationkey = k, f""")
def validation_partition(spark, sf_dir):
    """GRF5: whole components to validation, or none where that leaves a side empty."""
    return E.split_of_components(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey").select("c_custkey", "part")


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'test' WHEN o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%') THEN 'excluded' ELSE 'train' END AS part FROM orders""")
def strict_challenge(spark, sf_dir):
    """GRF7: groups that touch held values leave train whole."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    held = [r.o_orderpriority for r in o.where("o_orderpriority LIKE '1%'").select("o_orderpriority").distinct().collect()]  # values of one axis
    return E.strict_challenge(o, "o_orderpriority", held, "o_custkey").select("o_orderkey", "part")
