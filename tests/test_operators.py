"""Operators on small tables with known results."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import scalars as S
from tallyloom.operators import integrity, metrics, sequences, splits, texts
from tallyloom.operators.graph import connected_components
from tallyloom.sources import jsonl
from tallyloom.streaming import events


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_components_match_union_find(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400, k) for k in range(401, 480)] + [(k, k + 1) for k in range(500, 560)]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs + [(7, None)], "u long, v long")).collect()}
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    assert got == {n: find(n) for n in linked}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("text,word", [("- **EXECUTE now", "EXECUTE"), ("EXECUTED", None), ("avoid: x", "AVOID"), ("", None), (None, None), ("VERIFY_IT", None)])
def test_decision_token(spark, text, word):
    assert one(spark, S.decision_token(F.lit(text).cast("string"))) == word


def test_wilson_bounds(spark):
    w = one(spark, S.wilson(F.lit(0), F.lit(10)))
    assert w.low == 0 and abs(w.high - 0.2775) < 1e-3
    assert one(spark, S.wilson(F.lit(0), F.lit(0))) is None


def test_hash_mod_is_the_digest_modulo(spark):
    import hashlib

    for text in ("abc", "", "é"):
        assert one(spark, S.hash_mod(F.lit(text), 1000)) == int(hashlib.sha1(text.encode()).hexdigest(), 16) % 1000


def test_canonical_json_sorts_keys(spark):
    assert one(spark, S.canonical_json(F.lit('{"b": 1, "a": [1, {"d":null,"c":2}]}'))) == '{"a":[1,{"c":2,"d":null}],"b":1}'
    assert one(spark, S.canonical_json(F.lit("{bad"))) is None


def test_unobserved_rows_withhold_the_rate(spark):
    rows = spark.createDataFrame([("a", True, True), ("b", True, None), ("c", None, True)], "id string, risk boolean, hit boolean")
    r = metrics.rates(rows, [], [("m", F.col("risk"), F.col("hit"), F.col("hit").isNotNull())], "id").first()
    assert (r.numerator, r.denominator, r.rate, r.lower_bound, r.upper_bound, r.unknown_ids) == (1, 2, None, 0.5, 1.0, "b")


def test_noise_uses_rounding_half_to_even(spark):
    rows = spark.createDataFrame([(k, True) for k in range(10)], "id long, risk boolean")
    assert metrics.flip_noise(rows, "id", "risk", 0.05, 10).where("NOT risk").count() == 0
    assert metrics.flip_noise(rows, "id", "risk", 0.15, 10).where("NOT risk").count() == 2


def test_latest_known_variants(spark):
    rows = spark.createDataFrame([("a", 1, "UNKNOWN"), ("a", 2, "UNKNOWN"), ("b", 1, "X"), ("b", 2, "UNKNOWN")], "k string, i int, s string")
    assert {(r.k, r.i) for r in integrity.latest_known(rows, "k", "i", "s", "UNKNOWN").collect()} == {("a", 2), ("b", 1)}
    assert {(r.k, r.i) for r in integrity.latest_known(rows, "k", "i", "s", "UNKNOWN", last=False).collect()} == {("a", 1), ("b", 1)}


def test_strict_split_has_no_leak_and_needs_two_components(spark):
    values = spark.createDataFrame([(1, "s", "x"), (2, "s", "x"), (2, "t", "y"), (3, "t", "y"), (4, "s", "z")], "id long, axis string, value string")
    ids = spark.range(1, 6).select("id")
    comps = splits.isolation_components(values, ids)
    assert {(r.id, r.component) for r in comps.collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)}
    parted = splits.strict_partition(comps, 0.3)
    assert {r.side for r in parted.collect()} == {"train", "test"}
    assert all(r.n_overlap == 0 for r in splits.leakage(values, parted).collect())
    alone = splits.strict_partition(comps.where("component = 1"), 0.3)
    assert {r.side for r in alone.collect()} == {None}


def test_greedy_budget_takes_leading_rows(spark):
    rows = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (2, 1, 5), (2, 2, 5)], "g int, i int, n long")
    assert [(r.g, r.i) for r in sequences.greedy_budget(rows, ["g", "i"], "n", 11).orderBy("g", "i").collect()] == [(1, 1), (1, 2), (2, 1)]


def test_calls_are_literal_only():
    assert texts.parse_call("click('a1')") == ("click", ["'a1'"], "a1")
    assert texts.parse_call("fill('b', 'x y', True)") == ("fill", ["'b'", "'x y'", "True"], "b")
    for bad in ("click(a)", "click('a'); drop()", "x.click('a')", "", None, "click('a'"):
        assert texts.parse_call(bad) is None


def test_pruned_text_keeps_anchor_and_ancestors():
    text = "root\n\tsection\n\t\t[1] link 'a'\n\tother\n\t\t[2] button 'b'"
    out = texts.prune_lines(text, 0, {"2"})
    assert out.split("\n") == ["root", "…", "\tother", "\t\t[2] button 'b'"]
    assert texts.prune_lines(text, 10_000, {"2"}) == text


def test_controls_of_snapshots(spark):
    rows = spark.createDataFrame([(1, "[1] RootWebArea 'x'\n\t[a2] button 'Add it'\n\t\t[7] link plain\nnoise"), (2, None)], "id long, t string")
    found = texts.controls(rows, "id", "t").withColumn("click", texts.canonical_click(F.col("role"), F.col("name"), F.col("bid"))).orderBy("line").collect()
    assert [(r.bid, r.depth, r.click) for r in found] == [("a2", 1, "click:button:add-it"), ("7", 2, "click:link:plain")]


def test_strict_scan_routes_rejects(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"1","n":2}\n\n{"id":"2","n":3,"z":1}\n{"id":"3"}\nnot json\n{"id":"4","n":"x"}\n{"id":"5","n":1}\n{"id":"5","n":2}\n')
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([StructField("id", StringType()), StructField("n", LongType())])
    ok, bad = jsonl.strict_scan(spark, f"file://{tmp_path}/*.jsonl", schema, "id")
    assert [r.id for r in ok.collect()] == ["1"]
    codes = sorted(",".join(r.reasons) for r in bad.collect())
    assert codes == ["duplicate_key", "duplicate_key", "missing_fields:n", "not_json", "type:n", "unknown_fields:z"]
    ok, bad = jsonl.strict_scan(spark, f"file://{tmp_path}/none*.jsonl", schema, "id")
    assert ok.count() == bad.count() == 0


def test_pairs_and_runs(spark, tmp_path):
    body = spark.createDataFrame([("a", "r1"), ("b", "r2")], "id string, run_id string")
    jsonl.write_pair(body, body.select("id"), f"file://{tmp_path}/pair")
    kept, gone = jsonl.partition_by_run(spark, f"file://{tmp_path}/pair/body", "r1")
    assert (kept.count(), gone.count()) == (1, 1)
    with pytest.raises(Exception):
        jsonl.write_pair(body, body, f"file://{tmp_path}/pair")


def test_stream_gives_the_batch_result(spark, tmp_path):
    from .conftest import SF

    batch = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    expected = {(r.start, r.event_type): r.n for r in events.windowed_counts(batch).collect()}
    events.run_to_table(events.windowed_counts(events.read_events(spark, SF)), f"file://{tmp_path}/cp", f"file://{tmp_path}/out")
    got = {(r.start, r.event_type): r.n for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    # windows younger than the watermark are still open when the stream ends
    assert got and all(expected[k] == n for k, n in got.items())
