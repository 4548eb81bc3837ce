"""Evidence joins: exact matches between records with reasons for every row that fails, and derived views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.functions import scalars as S


def _found(rows: DataFrame, other: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """Left join to the only row of ``other`` with these keys; its columns get a prefix, and so does ``n``, the rows there are."""
    kept = [c for c in other.columns if c not in keys]
    one = other.groupBy(*keys).agg(F.count("*").alias(f"{prefix}n"), *[F.min(c).alias(f"{prefix}{c}") for c in kept])
    return rows.join(one, keys, "left").withColumn(f"{prefix}n", F.coalesce(f"{prefix}n", F.lit(0)))


def negative_pairs(negatives: DataFrame, samples: DataFrame, candidates: DataFrame, traces: DataFrame) -> DataFrame:
    """(error_id, reasons) of audited negatives against their sample, candidate and, for on-policy ones, trace.

    negatives: error_id, sample_id, candidate_id, source, trace_id, completion_hash; samples:
    sample_id, state_id, formal, topology; candidates: candidate_id, state_id, legal; traces:
    trace_id, sample_id, completion_hash, eligible.
    """
    t = _found(negatives, samples, ["sample_id"], "s_")
    t = _found(t, candidates, ["candidate_id"], "c_")
    t = _found(t, traces.withColumnRenamed("sample_id", "of"), ["trace_id"], "t_")
    c, policy, there = F.col, F.col("source") == "on_policy", F.col("t_n") == 1
    return t.select(
        "error_id",
        S.reasons(
            ("unknown_sample", c("s_n") == 0), ("sample_repeats", c("s_n") > 1), ("sample_not_formal", (c("s_n") == 1) & ~c("s_formal").eqNullSafe(True)), ("topology", (c("s_n") == 1) & ~c("s_topology").eqNullSafe("system,user,assistant")),
            ("unknown_candidate", c("candidate_id").isNotNull() & (c("c_n") == 0)), ("candidate_state", (c("c_n") == 1) & (c("s_n") == 1) & ~c("c_state_id").eqNullSafe(c("s_state_id"))), ("candidate_illegal", (c("c_n") == 1) & ~c("c_legal").eqNullSafe(True)),
            ("trace_missing", policy & ~there), ("trace_sample", policy & there & ~c("t_of").eqNullSafe(c("sample_id"))), ("trace_hash", policy & there & ~c("t_completion_hash").eqNullSafe(c("completion_hash"))), ("trace_not_eligible", policy & there & ~c("t_eligible").eqNullSafe(True)),
        ).alias("reasons"),
    )


def episode_lineage(rows: DataFrame, truths: DataFrame, points: DataFrame, fields: list[str]) -> DataFrame:
    """(row, reasons) of episodes against their truth, by case, and its point: missing, repeated and unknown cases, and fields that differ.

    rows: row, case_id, point_id and the fields; truths: case_id, point_id and the fields; points: point_id.
    """
    seats = Window.partitionBy("case_id").orderBy("row")  # rows of one case
    t = rows.withColumn("turn", F.row_number().over(seats))
    t = _found(t, truths, ["case_id"], "t_")
    t = t.join(points.select(F.col("point_id").alias("t_point_id"), F.lit(True).alias("p_there")).distinct(), "t_point_id", "left")
    named, known = F.coalesce(F.col("case_id"), F.lit("")) != "", F.col("t_n") == 1
    first = named & (F.col("turn") == 1)
    differ = [(f"differs:{n}", first & known & ~F.col(n).eqNullSafe(F.col(f"t_{n}"))) for n in ["point_id", *fields]]
    return t.select("row", S.reasons(("missing_case", ~named), ("repeated_case", named & (F.col("turn") > 1)), ("unknown_case", first & ~known), ("unknown_point", first & known & F.col("p_there").isNull()), *differ).alias("reasons"))


def snapshot_status(candidates: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(candidate_id, status) by the snapshot with the candidate's state and hash: ok, missing_snapshot, colliding_snapshot or absent_bid.

    candidates: candidate_id, state_id, snapshot_hash, bid; snapshots: state_id, snapshot (text).
    """
    shots = snapshots.where("coalesce(state_id, '') <> '' AND coalesce(snapshot, '') <> ''").select("state_id", S.sha256(F.col("snapshot")).alias("snapshot_hash"), "snapshot").distinct()
    t = _found(candidates, shots, ["state_id", "snapshot_hash"], "x_")
    line = F.concat(F.lit(r"(?m)^[ \t]*\["), F.col("bid"), F.lit(r"\][ \t]+[A-Za-z_]"))
    status = F.when(F.col("x_n") == 0, "missing_snapshot").when(F.col("x_n") > 1, "colliding_snapshot").when(~F.regexp_like("x_snapshot", line), "absent_bid").otherwise("ok")
    return t.select("candidate_id", status.alias("status"))


def transition_refs(rows: DataFrame, transitions: DataFrame) -> DataFrame:
    """(row, reasons) of training rows against the transition they name: id, state and record hash."""
    t = _found(rows, transitions, ["transition_id"], "x_")
    there = F.col("x_n") > 0
    return t.select("row", S.reasons(("missing_ref", F.col("transition_id").isNull()), ("unknown_transition", F.col("transition_id").isNotNull() & ~there), ("state_differs", there & ~F.col("state_id").eqNullSafe(F.col("x_state_id"))), ("hash_differs", there & ~F.col("record_hash").eqNullSafe(F.col("x_record_hash")))).alias("reasons"))


def reached_states(view: DataFrame, candidates: DataFrame, key_states: DataFrame, points: DataFrame) -> DataFrame:
    """The derived view (state_id, url) and, for states of candidates that it lacks, rows filled from key states, else from points, with their origin."""
    lacking = candidates.select("state_id").distinct().join(view.select("state_id"), "state_id", "left_anti")
    filled = lacking.join(key_states.groupBy("state_id").agg(F.min("url").alias("k")), "state_id", "left").join(points.groupBy("state_id").agg(F.min("url").alias("p")), "state_id", "left")
    origin = F.when(F.col("k").isNotNull(), "key_state").when(F.col("p").isNotNull(), "point").otherwise("nowhere")
    return view.select("state_id", "url", F.lit("view").alias("origin")).unionByName(filled.select("state_id", F.coalesce("k", "p").alias("url"), origin.alias("origin")))


def pairs_of_samples(pairs: DataFrame, samples: DataFrame, pair: str = "pair_id", sample: str = "sample_id", mark: str = "__") -> DataFrame:
    """Pairs with the sample whose id stands before the mark: the key is derived, so the join is one of equal keys."""
    return pairs.withColumn(sample, F.substring_index(pair, mark, 1)).where(F.instr(pair, mark) > 0).join(samples, sample)


def unseen(new: DataFrame, existing: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each new key that is not among the existing ones."""
    digest = F.xxhash64(*key)
    first = new.groupBy(*key).agg(F.min_by(F.struct(*[c for c in new.columns if c not in key]), F.struct(order, digest)).alias("x")).select(*key, "x.*")
    return first.join(existing.select(*key).distinct(), key, "left_anti").select(*new.columns)


def membership_overlap(members: DataFrame, most: int = 10) -> DataFrame:
    """(a, b, n, first_ids) for every two splits that share ids; members: split, id. Splits are few, ids are joined by key."""
    own = members.distinct()
    both = own.select(F.col("split").alias("a"), "id").join(own.select(F.col("split").alias("b"), "id"), "id").where("a < b")
    ranked = both.withColumn("turn", F.row_number().over(Window.partitionBy("a", "b").orderBy("id")))
    return ranked.groupBy("a", "b").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("turn") <= most, F.col("id")))), ",").alias("first_ids"))


def prefix_history(steps: DataFrame, states: DataFrame, key: str = "trajectory_id") -> DataFrame:
    """(state_id, n_history, last_action, alignment): what a trajectory did before the step of a state; aligned where no step lacks."""
    t = states.join(steps.withColumnRenamed("step_id", "at"), key, "left").where("at IS NULL OR at < step_id")
    n = t.groupBy("state_id", "step_id").agg(F.count_distinct("at").alias("n_history"), F.max_by("action", "at").alias("last_action"))
    every = states.select("state_id", "step_id").join(n, ["state_id", "step_id"], "left")
    n_history = F.coalesce("n_history", F.lit(0))
    return every.select("state_id", n_history.alias("n_history"), "last_action", F.when(n_history == F.col("step_id"), "aligned").when(n_history == 0, "none").otherwise("gap").alias("alignment"))


def history_source(trajectory: Column, plan: Column, canonical: Column) -> Column:
    """struct(history, source): the first that is there of trajectory, plan and canonical history."""
    said = lambda value, name: F.struct(value.alias("history"), F.lit(name).alias("source"))
    return F.when(F.coalesce(trajectory, F.lit("")) != "", said(trajectory, "trajectory")).when(F.coalesce(plan, F.lit("")) != "", said(plan, "plan")).when(F.coalesce(canonical, F.lit("")) != "", said(canonical, "canonical")).otherwise(said(F.lit(""), "none"))


def trace_values(steps: DataFrame, episodes: DataFrame, names: list[str], key: str = "episode_id") -> DataFrame:
    """Steps with their own value of each name, else the episode's, and whether the stored hash of the completion holds."""
    e = episodes.select(key, *[F.col(n).alias(f"e_{n}") for n in names])
    t = steps.join(e, key, "left")
    own = [F.coalesce(n, f"e_{n}").alias(n) for n in names]
    return t.select(*[c for c in steps.columns if c not in names], *own, (S.sha256(F.coalesce("completion", F.lit(""))) == F.col("completion_hash")).alias("hash_holds"))


def negative_id(sample: Column, trace: Column) -> Column:
    """Twenty hexadecimal digits of the digest of sample and trace, parted by a zero byte."""
    return F.substring(F.sha2(F.concat(sample.cast("binary"), F.lit(b"\x00"), trace.cast("binary")), 256), 1, 20)


def multiplicity(rows: DataFrame, key: str) -> DataFrame:
    """(times, ids): how many ids stand so many times."""
    return rows.groupBy(key).agg(F.count("*").alias("times")).groupBy("times").agg(F.count("*").alias("ids"))


def full_wilson(successes: Column, total: Column) -> Column:
    """Wilson bounds where nothing seen means (0, 1) and impossible counts mean null."""
    bounds = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    return F.when((successes < 0) | (total < 0) | (successes > total), F.lit(None)).when(total == 0, bounds).otherwise(S.wilson(successes, total))


def detection_report(trials: DataFrame, by: str) -> DataFrame:
    """tp, fp, fn, tn with precision, recall and their lower bounds; trials: detected, truth (booleans)."""
    d, t = F.col("detected"), F.col("truth")
    n = trials.groupBy(by).agg(F.count_if(d & t).alias("tp"), F.count_if(d & ~t).alias("fp"), F.count_if(~d & t).alias("fn"), F.count_if(~d & ~t).alias("tn"))
    low = lambda a, b: full_wilson(F.col(a), F.col(a) + F.col(b))["low"]
    part = lambda a, b: F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0))
    return n.select(by, "tp", "fp", "fn", "tn", part("tp", "fp").alias("precision"), part("tp", "fn").alias("recall"), low("tp", "fp").alias("precision_low"), low("tp", "fn").alias("recall_low"))


def class_scores(rows: DataFrame, truth: str, predicted: str, classes: list[str]) -> DataFrame:
    """Precision, recall, F1 and support of each class, and macro_f1 over the classes that occur; rows whose truth is none of them are left out."""
    own = rows.where(F.col(truth).isin(*classes))
    each = own.select(truth, predicted, F.explode(F.array(*map(F.lit, classes))).alias("class"))
    is_true, is_said = F.col(truth) == F.col("class"), F.coalesce(F.col(predicted) == F.col("class"), F.lit(False))
    n = each.groupBy("class").agg(F.count_if(is_true & is_said).alias("tp"), F.count_if(is_said).alias("said"), F.count_if(is_true).alias("support"))
    p, r = F.col("tp") / F.nullif("said", F.lit(0)), F.col("tp") / F.nullif("support", F.lit(0))
    f1 = F.when(F.col("support") > 0, 2 * F.col("tp") / (F.col("said") + F.col("support")))
    n = n.select("class", "support", p.alias("precision"), r.alias("recall"), f1.alias("f1"))
    return n.withColumn("macro_f1", F.avg("f1").over(Window.partitionBy()))  # one row for each class


def split_of_components(rows: DataFrame, component: str, share: int = 10) -> DataFrame:
    """Adds ``part``: validation for whole components with a digest in the first of ``share`` parts, unless every one or none would go; then all train."""
    mark = S.hash_mod(F.col(component).cast("string"), share) == 0
    sizes = rows.select(component, mark.alias("held")).distinct().agg(F.count_if("held").alias("held"), F.count("*").alias("n")).withColumn("fits", (F.col("held") > 0) & (F.col("held") < F.col("n"))).select("fits")
    t = rows.crossJoin(F.broadcast(sizes))  # one row
    return t.withColumn("part", F.when(F.col("fits") & mark, "validation").otherwise("train")).drop("fits")


def strict_challenge(rows: DataFrame, axis: str, held: list[str], group: str) -> DataFrame:
    """Adds ``part`` of a strict challenge: held values of an axis test, and whole groups that touch them leave train."""
    test = F.col(axis).isin(*held)
    touched = rows.where(test).select(group).distinct().withColumn("touched", F.lit(True))
    return rows.join(touched, group, "left").withColumn("part", F.when(test, "test").when(F.col("touched"), "excluded").otherwise("train")).drop("touched")
