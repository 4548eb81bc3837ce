"""Each rule of the validators with a row that breaks it and no other."""

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import episodes as E
from tallyloom.operators import observations as O
from tallyloom.operators import rules as R

TEXT = {name: "x" for name in {*R.POINT_FIELDS, *R.TRUTH_FIELDS, *R.TRANSITION_FIELDS}}
BASE = TEXT | {
    "schema_version": "v", "wanted_version": "v", "effect_status": "CHANGED", "recovery_status": "UNKNOWN", "undo_cost_steps": None, "budget_k": 5, "n_undo_actions": 0, "n_undo_semantic": 0, "n_undo_hashes": 0, "solver_set": "a,b,c",
    "union_protocol": None, "union_post_hash": None, "union_post_signal": None, "union_recovery": None, "union_budget": None, "union_solvers": None, "union_winner": None, "n_traces": 0, "trace_names": "", "n_kinds": 0, "n_attacker_seeds": 0,
    "is_mock": False, "evidence": "e", "candidate_snapshot_hash": "h", "pre_signal": "1", "post_signal": "2", "final_signal": "1", "residual_diff": "r",
}
NEGATIVE = {
    "recovery_status": "NOT_RECOVERED_WITHIN_BUDGET", "final_signal": "3", "union_protocol": "solver_union.v2", "union_post_hash": "x", "union_post_signal": "2", "union_recovery": "NOT_RECOVERED_WITHIN_BUDGET",
    "union_budget": 5, "union_solvers": "a,b,c", "n_traces": 3, "trace_names": "a,b,c", "n_kinds": 3, "n_attacker_seeds": 2,
}
RECOVERED = {"recovery_status": "RECOVERED", "undo_cost_steps": 2, "n_undo_actions": 2, "n_undo_semantic": 2, "n_undo_hashes": 2}
PARTIAL = RECOVERED | {"recovery_status": "PARTIALLY_RECOVERED", "final_signal": "9"}
POINT_CASES = {
    "schema_version": {"schema_version": "w"}, "effect_status": {"effect_status": "odd"}, "recovery_status": {"recovery_status": None}, "unknown_effect_with_recovery": RECOVERED | {"effect_status": "UNKNOWN"},
    "negative_cost": {"undo_cost_steps": -1}, "cost_over_budget": {"undo_cost_steps": 6}, "recovered_without_cost": RECOVERED | {"undo_cost_steps": None}, "cost_not_actions": RECOVERED | {"undo_cost_steps": 1},
    "cost_without_actions": RECOVERED | {"n_undo_actions": 0, "n_undo_semantic": 0, "n_undo_hashes": 0}, "semantic_actions_unaligned": RECOVERED | {"n_undo_semantic": 1}, "hashes_unaligned": RECOVERED | {"n_undo_hashes": 3}, "semantic_without_actions": {"n_undo_semantic": 1},
    "union_protocol": NEGATIVE | {"union_protocol": None}, "union_post_hash_missing": NEGATIVE | {"union_post_hash": ""}, "union_post_hash": NEGATIVE | {"union_post_hash": "y"}, "union_post_signal": NEGATIVE | {"union_post_signal": None},
    "union_recovery": NEGATIVE | {"union_recovery": "UNKNOWN"}, "union_budget": NEGATIVE | {"union_budget": 4}, "union_solvers": NEGATIVE | {"union_solvers": "a"}, "union_winner": NEGATIVE | {"union_winner": "a"}, "union_without_traces": NEGATIVE | {"n_traces": 0},
    "trace_names": NEGATIVE | {"trace_names": "a,c,b"}, "trace_kinds": NEGATIVE | {"n_kinds": 2}, "attacker_seeds": NEGATIVE | {"n_attacker_seeds": 1}, "is_mock": {"is_mock": None}, "without_evidence": {"evidence": "{}"}, "without_snapshot_hash": {"candidate_snapshot_hash": " "},
    "effect_without_pre_signal": {"pre_signal": "[]"}, "effect_without_post_signal": {"post_signal": None}, "changed_but_equal": {"post_signal": "1"}, "no_effect_but_changed": {"effect_status": "NO_EFFECT"}, "recovery_without_final_signal": RECOVERED | {"final_signal": ""},
    "recovered_but_differs": RECOVERED | {"final_signal": "2"}, "partial_but_restored": PARTIAL | {"final_signal": "1"}, "partial_without_residual": PARTIAL | {"residual_diff": "[]"}, "negative_but_restored": NEGATIVE | {"final_signal": "1"},
    "no_effect_with_recovery": RECOVERED | {"effect_status": "NO_EFFECT", "post_signal": "1"}, "without_solvers": {"solver_set": ""}, "without_budget": {"budget_k": 0},
    **{f"missing:{n}": {n: None} for n in R.POINT_FIELDS if n != "post_observation_hash"},
}
TRUTH_BASE = BASE | {
    "normative_risk": True, "policy_constraint_truth": False, "action_required_for_goal": False, "violates_constraint": True, "expected_decision": "AVOID", "backend_commit": None, "risky_attempt": None, "action_legal": None,
    "point_found": True, "point_state_id": "x", "point_effect_status": "CHANGED", "point_recovery_status": "UNKNOWN",
}
TRUTH_CASES = {
    "schema_version": {"schema_version": "w"}, "effect_status": {"effect_status": None, "point_effect_status": None}, "recovery_status": {"recovery_status": "odd", "point_recovery_status": "odd"}, "expected_decision": {"expected_decision": "no"},
    "commit_without_attempt": {"backend_commit": True}, "attempt_without_legality": {"risky_attempt": True}, "without_evidence": {"evidence": None}, "point:state_id": {"point_state_id": "y"}, "point:effect_status": {"point_effect_status": None}, "point:recovery_status": {"point_recovery_status": "RECOVERED"},
    **{f"missing:{n}": {n: " ", **({"point_state_id": " "} if n == "state_id" else {})} for n in R.TRUTH_FIELDS}, **{f"not_boolean:{n}": {n: None} for n in ("normative_risk", "policy_constraint_truth", "action_required_for_goal", "violates_constraint")},
}
MOVE_BASE = BASE | {"transition_id": "transition::x", "n_steps": 0, "n_step_indices": 0, "first_step": None, "last_step": None, "action_bid": "3", "bid_visible": True}
STEPS = {"recovery_status": "RECOVERED", "undo_cost_steps": 2, "n_steps": 2, "n_step_indices": 2, "first_step": 0, "last_step": 1}
MOVE_CASES = {
    "schema_version": {"schema_version": "w"}, "transition_id": {"transition_id": "transition::y"}, "effect_status": {"effect_status": "odd"}, "recovery_status": {"recovery_status": "odd"}, "budget": {"budget_k": None}, "cost_not_steps": STEPS | {"undo_cost_steps": 1},
    "step_indices_repeat": STEPS | {"n_step_indices": 1}, "step_indices_gap": STEPS | {"last_step": 2}, "steps_over_budget": STEPS | {"budget_k": 1}, "changed_but_equal": {"post_signal": "1"}, "no_effect_but_changed": {"effect_status": "NO_EFFECT"},
    "no_effect_with_steps": {"effect_status": "NO_EFFECT", "post_signal": "1", "undo_cost_steps": 0}, "recovered_but_differs": STEPS | {"final_signal": "2"}, "partial_but_restored": STEPS | {"recovery_status": "PARTIALLY_RECOVERED"},
    "recovery_without_cost": STEPS | {"undo_cost_steps": None}, "action_without_bid": {"action_bid": None}, "bid_absent": {"bid_visible": False}, "no_effect_with_recovery": STEPS | {"effect_status": "NO_EFFECT", "post_signal": "1"},
    **{f"missing:{n}": {n: None} for n in R.TRANSITION_FIELDS if n not in ("transition_id", "probe_point_id")},
}
#: Rules that cannot break without others.
TOGETHER = {
    "no_effect_with_recovery": {"no_effect_with_steps"}, "without_solvers": set(), "without_budget": set(), "unknown_effect_with_recovery": set(), "negative_cost": set(), "recovered_without_cost": {"cost_without_actions", "cost_not_actions"},
}


def schema(rows):
    kinds = {c: next((type(r[c]) for r in rows if r[c] is not None), str) for c in rows[0]}
    return ", ".join(f"`{c}` {({bool: 'boolean', int: 'int'}).get(k, 'string')}" for c, k in kinds.items())


@pytest.mark.parametrize("rules, base, cases", [(R.POINT, BASE, POINT_CASES), (R.TRUTH, TRUTH_BASE, TRUTH_CASES), (R.TRANSITION, MOVE_BASE, MOVE_CASES)], ids=["points", "truths", "transitions"])
def test_each_rule_has_a_row_that_breaks_it(spark, rules, base, cases):
    rows = [base | {"row": ""}] + [base | change | {"row": code} for code, change in cases.items()]
    t = spark.createDataFrame([tuple(r.values()) for r in rows], schema(rows))
    got = {r.row: set(r.errors) for r in R.violations(t, rules).select("row", "errors").collect()}
    assert got.pop("") == set()
    for code, errors in got.items():
        assert code in errors and errors - {code} <= TOGETHER.get(code, set()), (code, errors)
    untested = set(rules) - set(cases)
    assert untested <= {"negative_without_budget", "negative_without_solvers", "missing:post_observation_hash", "missing:probe_point_id", "missing:transition_id"}, untested


def test_absent_fields_differ_from_null_fields(spark):
    rows = [(1, {"outcome": "false_safe"}, []), (2, {"outcome": "false_safe", "risky_attempt": None}, []), (3, {"outcome": "respected"}, [("click('1')", "true", "execute"), ("noop()", None, None)]), (4, {"recovery_status": None, "reversibility": "REVERSIBLE"}, [])]
    t = spark.createDataFrame(rows, "row long, fields map<string,string>, steps array<struct<action:string,executed:string,decision:string>>")
    got = {r.row: r for r in E.truth_rows(t).collect()}
    assert (got[1].risky_attempt, got[1].action_legal) == (True, True) and (got[2].risky_attempt, got[2].action_legal) == (None, None)
    assert (got[3].risky_attempt, got[3].risky_action_executed, got[3].declared_decision, got[3].actual_action) == (False, False, "EXECUTE", "noop()")
    assert got[4].recovery_status == "UNKNOWN" and got[4].truth_source == "unqualified_recovery_only" and got[1].truth_source == "legacy_unqualified"


def test_message_parts_forms(spark):
    texts = ["<goal>\nBuy\n\n<history>\n(none)\n\n<observation>\ntree\n [1] link", "<goal>\nBuy\n\n<observation>\ntree", " just this \n", ""]
    t = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k long, m string")
    got = [tuple(r) for r in t.select("k", O.message_parts(F.col("m")).alias("x")).orderBy("k").select("x.*").collect()]
    assert got == [("Buy", "", "tree\n [1] link"), ("Buy", "", "tree"), ("just this", "", ""), ("", "", "")]
