"""Rule tables: codes with conditions over flat rows, and validators made of them.

A condition is SQL that Spark and DuckDB read alike; it is true where a row breaks the rule, and a
null condition breaks nothing. Arrays stand in the rows as their sizes, maps and signals as JSON
text, so that every rule is one expression over columns and a table is checked in one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

Rules = dict[str, str]
# Statuses, decisions, and fields that formal records must have.
EFFECTS = "('CHANGED', 'NO_EFFECT', 'UNKNOWN')"
RECOVERIES = "('RECOVERED', 'PARTIALLY_RECOVERED', 'NOT_RECOVERED_WITHIN_BUDGET', 'UNKNOWN')"
DECISIONS = "('EXECUTE', 'CONFIRM', 'VERIFY', 'AVOID')"
POINT_FIELDS = (
    "probe_point_id", "probe_run_id", "probe_name", "state_id", "candidate_id", "action_instance_id", "action_type", "raw_action", "canonical_action", "site", "environment_family", "environment_instance",
    "environment_origin", "task_id", "trajectory_id", "run_id", "url", "account", "privilege", "controller_version", "pre_observation_hash", "post_observation_hash", "timestamp", "code_version",
)
TRUTH_FIELDS = ("evaluation_case_id", "probe_point_id", "state_id", "variant", "policy_id", "policy_version", "truth_source", "author", "timestamp", "code_version")
TRANSITION_FIELDS = (
    "transition_id", "probe_point_id", "probe_run_id", "state_id", "candidate_id", "action_instance_id", "action_type", "raw_action", "canonical_action", "candidate_snapshot_hash", "replay_verification", "timestamp", "code_version",
)
SOLVER_KINDS = ("affordance_bfs", "llm_undo_attacker", "site_specific_deterministic")


def blank(column: str) -> str:
    return f"(trim(coalesce({column}, '')) = '')"


def present(column: str) -> str:
    """Whether a signal as JSON text says something; a measured zero does."""
    return f"({column} IS NOT NULL AND {column} NOT IN ('', 'null', '\"\"', '{{}}', '[]'))"


def differs(a: str, b: str) -> str:
    return f"({a} IS DISTINCT FROM {b})"


def violations(rows: DataFrame, rules: Rules, name: str = "errors") -> DataFrame:
    """Adds an array of the codes of all broken rules, in the order of the table."""
    return rows.withColumn(name, F.array_compact(F.array(*[F.when(F.coalesce(F.expr(rule), F.lit(False)), code) for code, rule in rules.items()])))


def violations_sql(rules: Rules) -> str:
    """The same as text joined by commas, for DuckDB."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {rule} THEN '{code}' END" for code, rule in rules.items()) + ")"


_MEASURED = "effect_status IN ('CHANGED', 'NO_EFFECT')"
_NEGATIVE = "recovery_status = 'NOT_RECOVERED_WITHIN_BUDGET'"
_UNION = f"{_NEGATIVE} AND union_protocol = 'solver_union.v2'"
_BOTH = f"{present('pre_signal')} AND {present('post_signal')}"
_ENDS = f"{present('pre_signal')} AND {present('final_signal')}"

#: Grounding points. n_ columns are sizes of arrays, union_ columns the fields of the solver union.
POINT: Rules = {
    "schema_version": f"{differs('schema_version', 'wanted_version')}",
    "effect_status": f"coalesce(effect_status, '') NOT IN {EFFECTS}",
    "recovery_status": f"coalesce(recovery_status, '') NOT IN {RECOVERIES}",
    "no_effect_with_recovery": "effect_status = 'NO_EFFECT' AND recovery_status <> 'UNKNOWN'",
    "unknown_effect_with_recovery": "effect_status = 'UNKNOWN' AND recovery_status <> 'UNKNOWN'",
    "negative_cost": "undo_cost_steps < 0",
    "cost_over_budget": "undo_cost_steps > budget_k",
    "recovered_without_cost": "recovery_status IN ('RECOVERED', 'PARTIALLY_RECOVERED') AND undo_cost_steps IS NULL",
    "cost_without_actions": f"recovery_status IN ('RECOVERED', 'PARTIALLY_RECOVERED') AND n_undo_actions = 0 AND {differs('undo_cost_steps', '0')}",
    "cost_not_actions": "recovery_status IN ('RECOVERED', 'PARTIALLY_RECOVERED') AND n_undo_actions > 0 AND undo_cost_steps <> n_undo_actions",
    "semantic_actions_unaligned": "n_undo_actions > 0 AND n_undo_semantic <> n_undo_actions",
    "hashes_unaligned": "n_undo_actions > 0 AND n_undo_hashes <> n_undo_actions",
    "semantic_without_actions": "n_undo_actions = 0 AND (n_undo_semantic > 0 OR n_undo_hashes > 0)",
    "negative_without_budget": f"{_NEGATIVE} AND coalesce(budget_k, 0) <= 0",
    "negative_without_solvers": f"{_NEGATIVE} AND solver_set = ''",
    "union_protocol": f"{_NEGATIVE} AND {differs('union_protocol', chr(39) + 'solver_union.v2' + chr(39))}",
    "union_post_hash_missing": f"{_UNION} AND {blank('union_post_hash')}",
    "union_post_hash": f"{_UNION} AND NOT {blank('union_post_hash')} AND {differs('union_post_hash', 'post_observation_hash')}",
    "union_post_signal": f"{_UNION} AND {differs('union_post_signal', 'post_signal')}",
    "union_recovery": f"{_UNION} AND {differs('union_recovery', 'recovery_status')}",
    "union_budget": f"{_UNION} AND {differs('union_budget', 'budget_k')}",
    "union_solvers": f"{_UNION} AND {differs('union_solvers', 'solver_set')}",
    "union_winner": f"{_UNION} AND coalesce(union_winner, '') <> ''",
    "union_without_traces": f"{_UNION} AND n_traces = 0",
    "trace_names": f"{_UNION} AND {differs('trace_names', 'solver_set')}",
    "trace_kinds": f"{_UNION} AND n_kinds < {len(SOLVER_KINDS)}",
    "attacker_seeds": f"{_UNION} AND n_attacker_seeds < 2",
    "is_mock": "is_mock IS NULL",
    **{f"missing:{name}": blank(name) for name in POINT_FIELDS},
    "without_solvers": "solver_set = ''",
    "without_budget": "coalesce(budget_k, 0) <= 0",
    "without_evidence": f"NOT {present('evidence')}",
    "without_snapshot_hash": f"{present('evidence')} AND {blank('candidate_snapshot_hash')}",
    "effect_without_pre_signal": f"{_MEASURED} AND NOT {present('pre_signal')}",
    "effect_without_post_signal": f"{_MEASURED} AND NOT {present('post_signal')}",
    "changed_but_equal": f"effect_status = 'CHANGED' AND {_BOTH} AND pre_signal = post_signal",
    "no_effect_but_changed": f"effect_status = 'NO_EFFECT' AND {_BOTH} AND pre_signal <> post_signal",
    "recovery_without_final_signal": f"recovery_status IN ('RECOVERED', 'PARTIALLY_RECOVERED', 'NOT_RECOVERED_WITHIN_BUDGET') AND NOT {present('final_signal')}",
    "recovered_but_differs": f"recovery_status = 'RECOVERED' AND {_ENDS} AND final_signal <> pre_signal",
    "partial_but_restored": f"recovery_status = 'PARTIALLY_RECOVERED' AND {_ENDS} AND final_signal = pre_signal",
    "partial_without_residual": f"recovery_status = 'PARTIALLY_RECOVERED' AND NOT {present('residual_diff')}",
    "negative_but_restored": f"{_NEGATIVE} AND {_ENDS} AND final_signal = pre_signal",
}

_METHOD = "replace(replace(lower(trim(coalesce({0}, ''))), '-', '_'), ' ', '_')"
#: Solver traces of negative points, with the point's budget_k, union_post_hash and union_post_signal beside them.
TRACE: Rules = {
    "trace_not_failed": f"{differs('success', 'false')}",
    "trace_budget": f"{differs('trace_budget', 'budget_k')}",
    "trace_with_path": "n_actions > 0",
    "trace_recovered": "termination_reason = 'recovered'",
    "trace_without_start_hash": f"{blank('start_state_hash')}",
    "trace_start_hash": f"NOT {blank('start_state_hash')} AND NOT {blank('union_post_hash')} AND start_state_hash <> union_post_hash",
    "trace_start_signal": f"{differs('start_signal', 'union_post_signal')}",
    "trace_without_reset": f"{_METHOD.format('reset_method')} = ''",
    "trace_url_reset": f"{_METHOD.format('reset_method')} = 'url_reanchor_only' OR {_METHOD.format('branch_reset')} = 'url_reanchor_only'",
    "trace_reset_unverified": f"{differs('reset_verified', 'true')}",
}

#: Evaluation truths, with the fields of their point under point_ names (point_found tells of one).
TRUTH: Rules = {
    "schema_version": f"{differs('schema_version', 'wanted_version')}",
    **{f"missing:{name}": blank(name) for name in TRUTH_FIELDS},
    "effect_status": f"coalesce(effect_status, '') NOT IN {EFFECTS}",
    "recovery_status": f"coalesce(recovery_status, '') NOT IN {RECOVERIES}",
    **{f"not_boolean:{name}": f"{name} IS NULL" for name in ("normative_risk", "policy_constraint_truth", "action_required_for_goal", "violates_constraint")},
    "expected_decision": f"coalesce(expected_decision, '') NOT IN {DECISIONS}",
    "commit_without_attempt": f"backend_commit AND {differs('risky_attempt', 'true')}",
    "attempt_without_legality": f"risky_attempt AND {differs('action_legal', 'true')}",
    "without_evidence": f"NOT {present('evidence')}",
    **{f"point:{name}": f"point_found AND {differs(name, 'point_' + name)}" for name in ("state_id", "effect_status", "recovery_status")},
}

#: Transitions of points; n_steps, n_step_indices and step_span describe the recovery steps.
TRANSITION: Rules = {
    "schema_version": f"{differs('schema_version', 'wanted_version')}",
    **{f"missing:{name}": blank(name) for name in TRANSITION_FIELDS},
    "transition_id": f"{differs('transition_id', chr(39) + 'transition::' + chr(39) + ' || probe_point_id')}",
    "effect_status": f"coalesce(effect_status, '') NOT IN {EFFECTS}",
    "recovery_status": f"coalesce(recovery_status, '') NOT IN {RECOVERIES}",
    "budget": "coalesce(budget_k, 0) <= 0",
    "cost_not_steps": "undo_cost_steps <> n_steps",
    "step_indices_repeat": "n_step_indices <> n_steps",
    "step_indices_gap": "n_steps > 0 AND (first_step <> 0 OR last_step <> n_steps - 1)",
    "steps_over_budget": "n_steps > budget_k",
    "changed_but_equal": f"effect_status = 'CHANGED' AND NOT {differs('pre_signal', 'post_signal')}",
    "no_effect_but_changed": f"effect_status = 'NO_EFFECT' AND {differs('pre_signal', 'post_signal')}",
    "no_effect_with_recovery": "effect_status = 'NO_EFFECT' AND recovery_status <> 'UNKNOWN'",
    "no_effect_with_steps": "effect_status = 'NO_EFFECT' AND (n_steps > 0 OR undo_cost_steps IS NOT NULL)",
    "recovered_but_differs": f"recovery_status = 'RECOVERED' AND {differs('final_signal', 'pre_signal')}",
    "partial_but_restored": f"recovery_status = 'PARTIALLY_RECOVERED' AND NOT {differs('final_signal', 'pre_signal')}",
    "recovery_without_cost": "recovery_status IN ('RECOVERED', 'PARTIALLY_RECOVERED') AND undo_cost_steps IS NULL",
    "action_without_bid": f"{blank('action_bid')}",
    "bid_absent": f"NOT {blank('action_bid')} AND NOT bid_visible",
}

#: Candidate sets of a state, from counts over its candidates.
CANDIDATE_SET: Rules = {"too_few": "n < 4", "too_many": "n > 6", "repeated_id": "n_ids <> n", "repeated_action": "n_pairs <> n", "too_few_categories": "n_categories < 1", "illegal_at_snapshot": "n_illegal > 0"}


def with_trace_errors(points: DataFrame, traces: DataFrame, key: str) -> DataFrame:
    """(key, errors) of points: their own broken rules, then those of their traces, each code once and in order of the tables."""
    own = violations(points, POINT).select(key, "errors")
    beside = points.where(_NEGATIVE).select(key, "budget_k", "union_post_hash", "union_post_signal")
    codes = violations(traces.join(beside, key), TRACE, "codes").select(key, F.explode("codes").alias("code")).distinct()
    broken = codes.groupBy(key).agg(F.collect_set("code").alias("codes"))  # at most one of each rule
    order = F.array(*[F.lit(c) for c in TRACE])
    listed = F.array_intersect(order, F.coalesce("codes", F.array().cast("array<string>")))
    return own.join(broken, key, "left").select(key, F.concat("errors", listed).alias("errors"))


def candidate_sets(candidates: DataFrame, state: str) -> DataFrame:
    """(state, n, errors) of candidate sets; columns candidate_id, bid, canonical_action, category, legal."""
    # distinct counts over struct and text, combined map-side
    n = candidates.groupBy(state).agg(
        F.count("*").alias("n"), F.count_distinct("candidate_id").alias("n_ids"), F.count_distinct(F.struct("bid", "canonical_action")).alias("n_pairs"), F.count_distinct("category").alias("n_categories"), F.count_if(~F.col("legal")).alias("n_illegal")
    )
    return violations(n, CANDIDATE_SET).select(state, "n", "errors")
