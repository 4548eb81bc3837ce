"""Queries on observations of pages; every event stands for an action between two observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyloom.operators import observations as O
from tallyloom.operators.texts import parsed_actions
from tallyloom.plans.registry import derived, in_duckdb, query, table
from tallyloom.session import materialize

VIEWS = """
SELECT event_id AS id, event_type AS kind, user_id,
  'http://shop.example/item/' || CAST(event_id % 7 AS STRING) AS url_before,
  'http://shop.example/item/' || CAST(CASE WHEN event_id % 4 = 0 THEN event_id % 5 ELSE event_id % 7 END AS STRING) || CASE WHEN event_id % 12 = 0 THEN '?list=' || CAST(user_id AS STRING) ELSE '' END AS url_after,
  CASE WHEN event_id % 3 = 0 THEN 'Shop' END AS title_before, CASE WHEN event_id % 3 = 0 AND event_id % 10 <> 0 THEN 'Shop' END AS title_after,
  'RootWebArea ''Page ' || CAST(event_id % 7 AS STRING) || '''' || chr(10) || chr(9) || '[' || CAST(event_id % 9 AS STRING) || '] button ''Add to cart''' || chr(10) || '    [12]  link ''Order #' || CAST(user_id % 50 AS STRING) || '''' || chr(10) || chr(10) || 'StaticText ''see [3] of it''' || chr(10) || '[8] searchbox ''Search the shop''' AS text_before,
  'RootWebArea ''Page ' || CAST(event_id % 7 AS STRING) || '''' || chr(10) || chr(9) || '[' || CAST((event_id + 1) % 9 AS STRING) || '] button ''' || CASE WHEN event_id % 6 = 0 THEN 'View cart' ELSE 'Add to cart' END || '''' || chr(10) || ' [12] link ''Order #' || CAST((user_id + CASE WHEN event_id % 8 = 0 THEN 1 ELSE 0 END) % 50 AS STRING) || '''' || chr(10) || 'StaticText ''see [' || CAST(event_id % 5 AS STRING) || '] of it''' || chr(10) || '[8] searchbox ''Search the shop''' AS text_after,
  'n=' || CAST(event_id % 2 AS STRING) AS form_before, 'n=' || CAST(CASE WHEN event_id % 9 = 0 THEN 5 ELSE event_id % 2 END AS STRING) AS form_after,
  CASE WHEN event_id % 5 < 2 THEN 'b' || CAST(user_id AS STRING) END AS backend_before, CASE WHEN event_id % 5 = 0 THEN 'b' || CAST(user_id AS STRING) WHEN event_id % 5 = 1 THEN 'c' END AS backend_after,
  CASE WHEN event_id % 11 < 2 THEN 's' END AS signal_before, CASE WHEN event_id % 11 = 0 THEN 's' WHEN event_id % 11 = 1 THEN 't' END AS signal_after,
  CASE event_id % 13 WHEN 0 THEN 'click(''3'')' WHEN 1 THEN 'click(''12'')' WHEN 2 THEN 'click(''' || CAST(event_id % 9 AS STRING) || ''')' WHEN 3 THEN 'goto(''http://shop.example/x'')' WHEN 4 THEN 'goto(''http://other.example/'')' WHEN 5 THEN 'noop()' WHEN 6 THEN 'fill(''8'', ''tea'')' WHEN 7 THEN 'fill(''12'', ''tea'')' WHEN 8 THEN 'press(''8'', ''Enter'')' WHEN 9 THEN 'click(' WHEN 10 THEN 'goto()' WHEN 11 THEN 'click(''8'')' END AS action
FROM {events}"""
_V = f"WITH v AS ({in_duckdb(VIEWS, 'events')})"
_STRIP = "array_to_string(list_filter(list_transform(string_split(regexp_replace({0}, '\\[[0-9]+\\]', '', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), lambda x: x <> ''), chr(10))"
_ORDERS = "list_sort(list_distinct(list_transform(regexp_extract_all({0}, '(?i)order\\s*#?\\s*([0-9]+)', 1), lambda x: 'order:' || x)))"
_WORDS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
_RUNS = "list_distinct(CASE WHEN len({0}) < 4 THEN {0} ELSE list_transform(range(1, len({0}) - 2), lambda i: array_to_string({0}[i:i + 3], ' ')) END)"
_STATE = f"""{_V}, p AS (SELECT *, {_STRIP.format('text_before')} AS p0, {_STRIP.format('text_after')} AS p1, {_ORDERS.format('text_before')} AS e0, {_ORDERS.format('text_after')} AS e1 FROM v),
w AS (SELECT *, {_WORDS.format('p0')} AS w0, {_WORDS.format('p1')} AS w1 FROM p), s AS (SELECT *, {_RUNS.format('w0')} AS s0, {_RUNS.format('w1')} AS s1 FROM w),
d AS (SELECT *, url_before <> url_after AS url, coalesce(title_before, '') <> coalesce(title_after, '') AS title, sha1(p0) <> sha1(p1) AS text, form_before <> form_after AS form, backend_before <> backend_after AS backend,
  round(1 - len(list_intersect(s0, s1)) / len(list_distinct(list_concat(s0, s1))), 4) AS drift, list_sort(list_filter(e1, lambda x: NOT list_contains(e0, x))) AS added, list_sort(list_filter(e0, lambda x: NOT list_contains(e1, x))) AS removed FROM s)"""


def views(spark, sf_dir) -> DataFrame:
    return derived(spark, sf_dir, VIEWS, "events")


def _distances(spark, sf_dir) -> DataFrame:
    """Fingerprints are stored, and so are their distances: rules name them often."""
    side = lambda s: O.fingerprint(*[F.col(f"{n}_{s}") for n in ("url", "title", "text", "form", "backend")]).alias(s)
    prints = materialize(views(spark, sf_dir).select("*", side("before"), side("after")), "fingerprints")
    return materialize(prints.withColumn("d", O.state_distance(F.col("before"), F.col("after"))), "state-distances")


@query(f"{_STATE} SELECT id, sha1(p0) AS text_hash, len(s0) AS n_shingles, array_to_string(e0, ',') AS entities FROM s")
def state_fingerprints(spark, sf_dir):
    """DER12, STR1, STR4: hashes of texts without volatile marks, shingles and named orders."""
    x = O.fingerprint(*[F.col(f"{n}_before") for n in ("url", "title", "text", "form", "backend")])
    return views(spark, sf_dir).select("id", x.alias("x")).select("id", "x.text_hash", F.size("x.shingles").alias("n_shingles"), F.array_join("x.entities", ",").alias("entities"))


@query(f"{_STATE} SELECT id, coalesce(NOT backend, NOT url AND NOT text AND NOT form AND len(added) = 0 AND len(removed) = 0 AND drift <= 0.05) AS restored, round(drift, 4) AS drift FROM d")
def restored_states(spark, sf_dir):
    """PRED5: the backend decides where observed, else all channels of the page must agree."""
    return _distances(spark, sf_dir).select("id", O.restored(F.col("d")).alias("restored"), F.col("d.drift").alias("drift"))


@query(f"""{_STATE}, n AS (SELECT *, concat_ws('; ', CASE WHEN len(added) > 0 THEN 'new order ' || array_to_string(list_transform(added, lambda x: '#' || split_part(x, ':', 2)), ', ') END, CASE WHEN len(removed) > 0 THEN 'order gone ' || array_to_string(list_transform(removed, lambda x: '#' || split_part(x, ':', 2)), ', ') END) AS signals,
  coalesce(title_after, regexp_extract(text_after, 'RootWebArea ''([^'']+)''', 1)) AS label, coalesce(backend, false) OR coalesce(signal_before <> signal_after, false) AS moved FROM d)
SELECT id, CASE WHEN moved THEN 'state-change' WHEN url THEN 'nav' WHEN form OR text OR title OR len(added) > 0 OR len(removed) > 0 THEN 'update' ELSE 'no-effect' END AS flag,
  CASE WHEN moved THEN CASE WHEN backend IS NOT NULL AND signals <> '' THEN signals ELSE 'persistent site signal changed' END || CASE WHEN url THEN ' (now on: ' || label || ')' ELSE '' END WHEN url THEN label || ' (' || substr(url_after, 20) || ')'
    WHEN form THEN 'form values changed (same page)' WHEN text OR title OR len(added) > 0 OR len(removed) > 0 THEN 'page content changed (same URL)' ELSE 'no visible change' END AS delta FROM n""")
def observed_deltas(spark, sf_dir):
    """STR13, WIN1, STR14: what an action changed, from state over navigation and update to nothing."""
    label = O.page_label(F.col("title_after"), F.col("text_after"))
    x = O.observed_delta(F.col("d"), F.col("signal_before") != F.col("signal_after"), label, F.col("url_after"))
    return _distances(spark, sf_dir).select("id", x.alias("x")).select("id", "x.flag", "x.delta")


_BIDS = "list_transform(list_filter(string_split({0}, chr(10)), lambda x: regexp_matches(x, '^[ \\t]*\\[[^\\]]+\\][ \\t]+(button|link|searchbox)')), lambda x: regexp_extract(x, '\\[([^\\]]+)\\]', 1))"
_BUCKET = f"CASE WHEN action IS NULL THEN 'invalid' WHEN NOT regexp_matches(action, '^click\\(''[^'']+''\\)$') THEN 'non_bid' WHEN list_contains({_BIDS.format('text_before')}, regexp_extract(action, '''([^'']+)''', 1)) THEN 'visible' ELSE 'missing' END"


@query(f"{_V} SELECT id, {_BUCKET} AS bucket FROM v")
def visible_bids(spark, sf_dir):
    """PRED1: whether clicks name a control of their page, by exact controls."""
    return O.visibility(views(spark, sf_dir), "id", "action", "text_before")


@query(f"{_V} SELECT kind, count(*) AS n, count(*) FILTER (b = 'visible') AS visible, count(*) FILTER (b = 'missing') AS missing, count(*) FILTER (b = 'invalid') AS invalid, count(*) FILTER (b = 'non_bid') AS non_bid FROM (SELECT kind, {_BUCKET} AS b FROM v) GROUP BY kind")
def visibility_audit(spark, sf_dir):
    """AUD1: buckets of bid visibility by kind of action."""
    v = views(spark, sf_dir)
    t = O.visibility(v, "id", "action", "text_before").join(v.select("id", "kind"), "id")
    return t.groupBy("kind").agg(F.count("*").alias("n"), *[F.count_if(F.col("bucket") == b).alias(b) for b in ("visible", "missing", "invalid", "non_bid")])


@query(f"""{_V}, c AS (SELECT id, side, regexp_extract(line, '\\] +([a-z]+)', 1) || ' ' || regexp_extract(line, '''(.*)''', 1) AS control FROM (SELECT id, 0 AS side, unnest(string_split(text_before, chr(10))) AS line FROM v UNION ALL SELECT id, 1, unnest(string_split(text_after, chr(10))) FROM v)
  WHERE regexp_matches(line, '^[ \\t]*\\[[^\\]]+\\][ \\t]+(button|link|searchbox)')), g AS (SELECT id, control, bool_or(side = 0) AS old, bool_or(side = 1) AS new FROM c GROUP BY id, control)
SELECT id, coalesce(string_agg(control, '; ' ORDER BY control) FILTER (NOT old), '') AS added, coalesce(string_agg(control, '; ' ORDER BY control) FILTER (NOT new), '') AS removed FROM g GROUP BY id""")
def control_changes(spark, sf_dir):
    """SET8: controls that appeared or went between two observations."""
    return O.control_changes(views(spark, sf_dir), "id", "text_before", "text_after")


MESSAGES = """
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '<goal>' || chr(10) || role || ' asks' || chr(10) || chr(10) || '<history>' || chr(10) || CASE WHEN conv_id % 2 = 0 THEN '(none)' ELSE '1. went on' END || chr(10) || chr(10) || '<observation>' || chr(10) || coalesce(text, '') || chr(10)
  WHEN 1 THEN '<goal>' || chr(10) || role || chr(10) || chr(10) || '<observation>' || chr(10) || 'tree ' || CAST(turn AS STRING) WHEN 2 THEN ' ' || role || chr(10) ELSE '<observation>' || chr(10) || 'x' END AS message, text
FROM {conversations}"""


@query(f"""WITH m AS ({in_duckdb(MESSAGES, 'conversations')}) SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN split_part(message, chr(10), 2) WHEN 1 THEN split_part(message, chr(10), 2) WHEN 2 THEN trim(message, ' ' || chr(10)) ELSE message END AS goal,
  CASE WHEN turn % 4 = 0 AND conv_id % 2 <> 0 THEN '1. went on' ELSE '' END AS history, CASE turn % 4 WHEN 0 THEN trim(coalesce(text, ''), ' ' || chr(10) || chr(9) || chr(13)) WHEN 1 THEN 'tree ' || turn ELSE '' END AS obs FROM m""")
def message_parts(spark, sf_dir):
    """STR12: goal, history and observation of user messages, in the present and the older form."""
    m = derived(spark, sf_dir, MESSAGES, "conversations")
    return m.select("conv_id", "turn", O.message_parts(F.col("message")).alias("x")).select("conv_id", "turn", "x.*")


_MOD = "list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 41), lambda i: CAST(instr('0123456789abcdef', substr(sha1({0}), i, 1)) - 1 AS BIGINT))), lambda a, b: (a * 16 + b) % {1})"


@query(f"""WITH s AS (SELECT o_orderkey, 'state-' || o_custkey AS s, o_orderkey % 2 = 0 AS request FROM orders), h AS (SELECT *, {_MOD.format("s || '|style'", 3)} = 0 AS hidden FROM s)
SELECT o_orderkey, CASE WHEN request THEN 'request' WHEN hidden THEN 'implicit_constraint' ELSE 'explicit_constraint' END AS style,
  CAST(CASE WHEN request THEN {_MOD.format("s || '|request'", 5)} WHEN hidden THEN {_MOD.format("s || '|constraint'", 5)} ELSE {_MOD.format("s || '|constraint'", 11)} END AS INTEGER) AS number FROM h""")
def goal_templates(spark, sf_dir):
    """PRJ11: templates of goals by hashes of their states."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("state-"), F.col("o_custkey").cast("string")).alias("s"))
    x = O.goal_template(F.col("s"), F.when(F.col("o_orderkey") % 2 == 0, "request").otherwise("constraint"), 11, 5, 5)
    return o.select("o_orderkey", x.alias("x")).select("o_orderkey", "x.*")


LABELS = """
SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN 'REVERSIBLE' WHEN 1 THEN 'reversible_with_cost (2)' WHEN 2 THEN 'Partially_Recoverable' WHEN 3 THEN 'IRREVERSIBLE' WHEN 4 THEN 'NO_EFFECT' WHEN 5 THEN '' WHEN 6 THEN 'odd' WHEN 7 THEN 'NOT_RECOVERED_WITHIN_BUDGET' WHEN 8 THEN 'unknown' END AS label,
  CASE o_orderkey % 4 WHEN 0 THEN ' URL reanchor-only ' WHEN 1 THEN 'Fresh-Context' WHEN 2 THEN o_orderpriority END AS method FROM {orders}"""


@query(f"""WITH l AS ({in_duckdb(LABELS, 'orders')}), m(word, effect, recovery, shown) AS (VALUES ('REVERSIBLE', 'CHANGED', 'RECOVERED', 'REVERSIBLE'), ('REVERSIBLE_WITH_COST (2)', 'CHANGED', 'RECOVERED', 'REVERSIBLE'), ('PARTIALLY_RECOVERABLE', 'CHANGED', 'PARTIALLY_RECOVERED', 'PARTIALLY_RECOVERABLE'),
  ('IRREVERSIBLE', 'CHANGED', 'NOT_RECOVERED_WITHIN_BUDGET', 'NOT_RECOVERED_WITHIN_BUDGET'), ('NO_EFFECT', 'NO_EFFECT', 'UNKNOWN', 'NO_EFFECT'), ('NOT_RECOVERED_WITHIN_BUDGET', 'CHANGED', 'NOT_RECOVERED_WITHIN_BUDGET', 'NOT_RECOVERED_WITHIN_BUDGET'), ('UNKNOWN', 'UNKNOWN', 'UNKNOWN', 'UNKNOWN'))
SELECT o_orderkey, effect, recovery, shown, effect IS NULL AS unknown_label, replace(replace(lower(trim(coalesce(method, ''))), '-', '_'), ' ', '_') AS method FROM l LEFT JOIN m ON upper(coalesce(nullif(label, ''), 'UNKNOWN')) = word""")
def legacy_labels(spark, sf_dir):
    """PRJ9, STR27: old labels as effect and recovery and back, labels that are none, reset methods."""
    t = derived(spark, sf_dir, LABELS, "orders").withColumn("x", O.legacy_statuses(F.col("label")))
    shown = F.when(F.col("x").isNotNull(), O.display_label(F.col("x.effect"), F.col("x.recovery")))
    return t.select("o_orderkey", "x.effect", "x.recovery", shown.alias("shown"), F.col("x").isNull().alias("unknown_label"), O.reset_method(F.col("method")).alias("method"))


def _calls(spark, sf_dir) -> DataFrame:
    v = views(spark, sf_dir)
    calls = parsed_actions(v, "id", "action").select(F.col("id").cast("long").alias("id"), F.when(F.col("name").isNotNull(), F.struct("name", "args", "bid")).alias("call"))
    return v.join(calls, "id")


@query(f"""{_V} SELECT id, CASE WHEN action IS NULL OR action = 'click(' THEN 'unparseable_action' WHEN action = 'noop()' THEN NULL WHEN action = 'goto()' THEN 'goto_requires_literal_url' WHEN action LIKE 'goto%other%' THEN 'cross_origin_navigation' WHEN action LIKE 'goto%' THEN NULL WHEN action LIKE 'press%' THEN 'primitive_not_read_only:press'
  WHEN len(hits) <> 1 THEN split_part(action, '(', 1) || '_bid_not_uniquely_visible' WHEN contains(hits[1], 'StaticText') AND NOT regexp_matches(hits[1], '\\[[^\\]]+\\] +([A-Za-z_][A-Za-z0-9_-]*)') THEN 'interactive_role_unparseable' WHEN contains(hits[1], 'Add to cart') THEN 'mutation_like_control'
  WHEN action LIKE 'fill%' THEN CASE WHEN contains(hits[1], 'searchbox') THEN NULL ELSE 'fill_not_search_field' END WHEN contains(hits[1], '] link') OR contains(hits[1], ']  link') THEN NULL WHEN contains(hits[1], 'searchbox') THEN 'click_role_or_label_not_read_only:searchbox' WHEN contains(hits[1], '] of') THEN 'click_role_or_label_not_read_only:of' END AS reason
  FROM (SELECT *, list_filter(string_split(text_before, chr(10)), lambda x: regexp_extract(x, '\\[([^\\]]+)\\]', 1) = regexp_extract(action, '''([^'']+)''', 1)) AS hits FROM v)""")
def read_only_reasons(spark, sf_dir):
    """VAL23: why actions are not surely read-only."""
    return O.read_only_reason(_calls(spark, sf_dir), "id", "call", "url_before", "text_before")


@query(f"""{_V}, a AS (SELECT id, kind, nullif(action, 'click(') AS action FROM v), t AS (SELECT kind, nullif(arg_min(action, id), 'click(') AS target FROM v WHERE action IS NOT NULL GROUP BY kind)
SELECT id, coalesce(CASE WHEN regexp_matches(target, '^(click|fill|press)\\(') THEN regexp_extract(a.action, '^([a-z]+\\(''[^'']*'')', 1) = regexp_extract(target, '^([a-z]+\\(''[^'']*'')', 1) ELSE a.action = target END, false) AS same FROM a JOIN t ON a.kind = t.kind""")
def same_actions(spark, sf_dir):
    """STR18: executed actions against a wanted one, by bid or by arguments."""
    t = _calls(spark, sf_dir)
    wanted = t.where("action IS NOT NULL").groupBy("kind").agg(F.min_by("call", "id").alias("wanted"))
    return t.join(wanted, "kind").select("id", O.same_action(F.col("call"), F.col("wanted")).alias("same"))


@query(f"""{_V} SELECT id, concat_ws(',', CASE WHEN contains(text_after, 'Add to cart') THEN 'add_to_cart' END) AS hints, CASE id % 7 WHEN 0 THEN 'fallback' ELSE 'shopping' END AS site FROM v""")
def page_hints(spark, sf_dir):
    """DER10: what pages afford, and their site by origin where only one has it."""
    v = views(spark, sf_dir).withColumn("at", F.when(F.col("id") % 7 == 0, "https://shop.example/item").otherwise(F.col("url_after")))
    sites = spark.createDataFrame([("shopping", "http://shop.example/"), ("twice", "http://two.example"), ("again", "http://two.example/x")], "site string, base string")
    t = O.site_of(v, "at", sites, F.lit("fallback"))
    return t.select("id", F.array_join(O.afforded(F.col("text_after"), F.col("url_after")), ",").alias("hints"), "site")
