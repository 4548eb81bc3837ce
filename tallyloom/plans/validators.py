"""Queries of the validators. Orders stand for points and truths, line items for traces, steps and candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import rules as R
from tallyloom.plans.registry import derived, in_duckdb, query

_NAMED = "CASE WHEN (o_orderkey * {1} + o_custkey) % 37 = {2} THEN {3} ELSE '{0}-' || CAST(o_custkey AS STRING) END AS {0}"


def _fields(names: tuple[str, ...], but: tuple[str, ...] = ()) -> str:
    """Columns that are blank or null in some rows each."""
    return ", ".join(_NAMED.format(n, k % 7 + 1, k, "NULL" if k % 2 else "' '") for k, n in enumerate(names) if n not in but)


POINTS = f"""
SELECT o_orderkey AS row, CASE WHEN o_custkey % 41 = 0 THEN 'v1' ELSE 'v2' END AS schema_version, 'v2' AS wanted_version,
  CASE o_orderkey % 8 WHEN 0 THEN 'NO_EFFECT' WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN 'odd' ELSE 'CHANGED' END AS effect_status,
  CASE o_custkey % 6 WHEN 0 THEN 'RECOVERED' WHEN 1 THEN 'PARTIALLY_RECOVERED' WHEN 2 THEN 'UNKNOWN' WHEN 3 THEN NULL ELSE 'NOT_RECOVERED_WITHIN_BUDGET' END AS recovery_status,
  CASE WHEN (o_orderkey + o_custkey) % 5 < 4 THEN (o_orderkey + o_custkey) % 5 - CASE WHEN o_custkey % 29 = 0 THEN 3 ELSE 0 END END AS undo_cost_steps, CASE o_orderkey % 9 WHEN 0 THEN 0 WHEN 1 THEN NULL WHEN 2 THEN 1 ELSE 5 END AS budget_k,
  (o_orderkey + o_custkey) % 5 % 4 AS n_undo_actions, (o_orderkey + o_custkey) % 5 % 4 + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS n_undo_semantic, (o_orderkey + o_custkey) % 5 % 4 + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS n_undo_hashes,
  CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'a,b,c' END AS solver_set, CASE WHEN o_orderkey % 7 = 0 THEN 'solver_union.v1' WHEN o_orderkey % 7 = 1 THEN NULL ELSE 'solver_union.v2' END AS union_protocol,
  CASE o_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'other' ELSE 'post_observation_hash-' || CAST(o_custkey AS STRING) END AS union_post_hash, CASE WHEN o_custkey % 8 = 0 THEN NULL ELSE CAST(o_orderkey % 4 AS STRING) END AS union_post_signal,
  CASE WHEN o_custkey % 9 = 0 THEN 'UNKNOWN' ELSE 'NOT_RECOVERED_WITHIN_BUDGET' END AS union_recovery, CASE o_orderkey % 9 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 5 END AS union_budget, CASE WHEN o_custkey % 10 = 0 THEN 'a,c' ELSE 'a,b,c' END AS union_solvers,
  CASE WHEN o_custkey % 11 = 0 THEN 'a' WHEN o_custkey % 11 = 1 THEN '' END AS union_winner, o_custkey % 12 AS n_traces, CASE WHEN o_custkey % 13 = 0 THEN 'b,a,c' ELSE 'a,b,c' END AS trace_names, o_orderkey % 4 AS n_kinds, o_custkey % 4 AS n_attacker_seeds,
  CASE WHEN o_orderkey % 14 > 0 THEN o_orderkey % 2 = 0 END AS is_mock, CASE o_orderkey % 15 WHEN 0 THEN NULL WHEN 1 THEN '[]' ELSE 'some' END AS evidence, CASE WHEN o_custkey % 15 = 0 THEN '' ELSE 'h' END AS candidate_snapshot_hash,
  CASE WHEN o_orderkey % 16 = 0 THEN '' ELSE CAST(o_custkey % 3 AS STRING) END AS pre_signal, CASE WHEN o_orderkey % 17 = 0 THEN 'null' ELSE CAST(o_orderkey % 4 AS STRING) END AS post_signal, CASE WHEN o_orderkey % 18 = 0 THEN NULL ELSE CAST((o_orderkey + o_custkey) % 3 AS STRING) END AS final_signal,
  CASE WHEN o_orderkey % 3 = 0 THEN 'left' ELSE '[]' END AS residual_diff, {_fields(R.POINT_FIELDS)}
FROM {{orders}}"""
TRACES = """
SELECT l_orderkey AS row, CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN l_partkey % 9 = 0 ELSE false END AS success, CASE l_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE 5 END AS trace_budget, CASE WHEN l_partkey % 10 = 0 THEN 2 ELSE 0 END AS n_actions,
  CASE l_suppkey % 7 WHEN 0 THEN 'recovered' WHEN 1 THEN NULL ELSE 'budget' END AS termination_reason, CASE l_partkey % 8 WHEN 0 THEN '' WHEN 1 THEN 'other' ELSE 'post_observation_hash-' || CAST(l_orderkey AS STRING) END AS start_state_hash, CAST(l_orderkey % 4 AS STRING) AS start_signal,
  CASE l_partkey % 5 WHEN 0 THEN ' URL Reanchor-Only' WHEN 1 THEN '' ELSE 'fresh' END AS reset_method, CASE WHEN l_suppkey % 11 = 0 THEN 'url_reanchor_only' END AS branch_reset, CASE l_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS reset_verified
FROM {lineitem}"""


@query(f"""WITH p AS ({in_duckdb(POINTS, 'orders')}), t AS ({in_duckdb(TRACES, 'lineitem')}), own AS (SELECT row, {R.violations_sql(R.POINT)} AS errors FROM p),
b AS (SELECT t.*, budget_k, union_post_hash, union_post_signal FROM t JOIN p ON t.row = p.row WHERE recovery_status = 'NOT_RECOVERED_WITHIN_BUDGET'),
c AS (SELECT row, {', '.join(f"bool_or(coalesce({rule}, false)) AS c{k}" for k, rule in enumerate(R.TRACE.values()))} FROM b GROUP BY row)
SELECT own.row, concat_ws(',', nullif(errors, ''), {', '.join(f"CASE WHEN c{k} THEN '{code}' END" for k, code in enumerate(R.TRACE))}) AS errors FROM own LEFT JOIN c ON own.row = c.row""")
def point_errors(spark, sf_dir):
    """VAL1: the rules of grounding points and of the solver traces of negative ones."""
    t = R.with_trace_errors(derived(spark, sf_dir, POINTS, "orders"), derived(spark, sf_dir, TRACES, "lineitem"), "row")
    return t.select("row", F.array_join("errors", ",").alias("errors"))


TRUTHS = f"""
SELECT o_orderkey AS row, CASE WHEN o_custkey % 31 = 0 THEN 'v1' ELSE 'v1.truth' END AS schema_version, 'v1.truth' AS wanted_version, {_fields(R.TRUTH_FIELDS, ('state_id',))},
  CASE WHEN o_orderkey % 12 = 0 THEN '' ELSE 'state-' || CAST(o_orderkey % 6 AS STRING) END AS state_id, CASE o_orderkey % 4 WHEN 0 THEN 'CHANGED' WHEN 1 THEN 'NO_EFFECT' WHEN 2 THEN 'UNKNOWN' END AS effect_status, CASE o_custkey % 4 WHEN 0 THEN 'RECOVERED' WHEN 1 THEN 'maybe' ELSE 'UNKNOWN' END AS recovery_status,
  CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 2 = 0 END AS normative_risk, CASE WHEN o_orderkey % 6 > 0 THEN true END AS policy_constraint_truth, CASE WHEN o_orderkey % 7 > 0 THEN false END AS action_required_for_goal, CASE WHEN o_orderkey % 8 > 0 THEN true END AS violates_constraint,
  CASE o_custkey % 5 WHEN 0 THEN 'EXECUTE' WHEN 1 THEN 'AVOID' WHEN 2 THEN 'no' WHEN 3 THEN NULL ELSE 'VERIFY' END AS expected_decision, CASE o_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS backend_commit, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS risky_attempt,
  CASE (o_orderkey + o_custkey) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS action_legal, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'why' END AS evidence, o_custkey % 2 = 0 AS point_found,
  'state-' || CAST(o_orderkey % 6 AS STRING) AS point_state_id, CASE o_orderkey % 4 WHEN 0 THEN 'CHANGED' ELSE 'NO_EFFECT' END AS point_effect_status, 'UNKNOWN' AS point_recovery_status
FROM {{orders}}"""


@query(f"WITH t AS ({in_duckdb(TRUTHS, 'orders')}) SELECT row, {R.violations_sql(R.TRUTH)} AS errors FROM t")
def truth_errors(spark, sf_dir):
    """VAL3: the rules of evaluation truths, a commit needing an attempt and an attempt a legal action, and agreement with the point."""
    return R.violations(derived(spark, sf_dir, TRUTHS, "orders"), R.TRUTH).select("row", F.array_join("errors", ",").alias("errors"))


TRANSITIONS = f"""
SELECT o.o_orderkey AS row, CASE WHEN o_custkey % 31 = 0 THEN 'v1' ELSE 'v2' END AS schema_version, 'v2' AS wanted_version, {_fields(R.TRANSITION_FIELDS, ('transition_id',))},
  CASE WHEN o.o_orderkey % 10 = 0 THEN 'other' ELSE 'transition::probe_point_id-' || CAST(o_custkey AS STRING) END AS transition_id, CASE o.o_orderkey % 5 WHEN 0 THEN 'NO_EFFECT' WHEN 1 THEN 'x' ELSE 'CHANGED' END AS effect_status, CASE o_custkey % 5 WHEN 0 THEN 'RECOVERED' WHEN 1 THEN 'PARTIALLY_RECOVERED' WHEN 2 THEN NULL ELSE 'UNKNOWN' END AS recovery_status,
  CASE o.o_orderkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN NULL ELSE 7 END AS budget_k, CASE WHEN o_custkey % 4 > 0 THEN coalesce(s.n, 0) + CASE WHEN o_custkey % 7 = 0 THEN 1 ELSE 0 END END AS undo_cost_steps,
  coalesce(s.n, 0) AS n_steps, coalesce(s.m, 0) AS n_step_indices, s.low AS first_step, s.high AS last_step, CAST(o_custkey % 3 AS STRING) AS pre_signal, CAST(o.o_orderkey % 3 AS STRING) AS post_signal, CASE WHEN o.o_orderkey % 4 > 0 THEN CAST(o_custkey % 3 AS STRING) END AS final_signal,
  CASE WHEN o.o_orderkey % 7 > 0 THEN 'b' END AS action_bid, o.o_orderkey % 8 > 0 AS bid_visible
FROM {{orders}} o LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS m, min(l_linenumber) - 1 AS low, max(l_linenumber) - 1 AS high FROM {{lineitem}} GROUP BY l_orderkey) s ON s.l_orderkey = o.o_orderkey"""


@query(f"WITH t AS ({in_duckdb(TRANSITIONS, 'orders', 'lineitem')}) SELECT row, {R.violations_sql(R.TRANSITION)} AS errors FROM t")
def transition_errors(spark, sf_dir):
    """VAL2: the rules of transitions and of their recovery steps."""
    return R.violations(derived(spark, sf_dir, TRANSITIONS, "orders", "lineitem"), R.TRANSITION).select("row", F.array_join("errors", ",").alias("errors"))


CANDIDATES = """
SELECT l_orderkey AS state, CAST(l_partkey % 50 AS STRING) AS candidate_id, CAST(l_suppkey % 7 AS STRING) AS bid, 'click:' || l_returnflag AS canonical_action, CASE WHEN l_linestatus = 'O' THEN 'risky' END AS category, l_partkey % 40 > 0 AS legal FROM {lineitem}"""


@query(f"""WITH c AS ({in_duckdb(CANDIDATES, 'lineitem')}), n AS (SELECT state, count(*) AS n, count(DISTINCT candidate_id) AS n_ids, count(DISTINCT (bid, canonical_action)) AS n_pairs, count(DISTINCT category) AS n_categories, count(*) FILTER (NOT legal) AS n_illegal FROM c GROUP BY state)
SELECT state, n, {R.violations_sql(R.CANDIDATE_SET)} AS errors FROM n""")
def candidate_set_errors(spark, sf_dir):
    """VAL5: sets of four to six legal candidates without repeats."""
    return R.candidate_sets(derived(spark, sf_dir, CANDIDATES, "lineitem"), "state").select("state", "n", F.array_join("errors", ",").alias("errors"))
