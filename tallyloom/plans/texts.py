"""Queries on vocabularies, controls, tags, fingerprints and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import scalars as S
from tallyloom.operators import texts as X
from tallyloom.plans.registry import query, table


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, CASE event_type WHEN 'purchase' THEN 'CHANGED' WHEN 'view' THEN 'NO_EFFECT' ELSE 'UNKNOWN' END AS effect,
  CASE WHEN event_id % 4 = 0 THEN true WHEN event_id % 4 = 1 THEN false END AS flag FROM events""")
def vocabularies(spark, sf_dir):
    """PRJ2, PRJ4, JSN1: effect labels, tri-state flags and JSON fields."""
    t, e = table(spark, sf_dir, "events"), F.col("event_type")
    raw = F.when(e == "purchase", " changed ").when(e == "view", None).otherwise("")
    legacy = F.when(e == "view", "no_effect").otherwise("unknown")
    flag = F.when(F.col("event_id") % 4 == 0, "yes").when(F.col("event_id") % 4 == 1, "Allowed").when(F.col("event_id") % 4 == 2, "perhaps")
    return t.select("event_id", F.get_json_object("props", "$.k").alias("k"), S.effect_status(raw, legacy).alias("effect"), S.explicit_bool(flag).alias("flag"))


@query("""SELECT conv_id, turn, nullif(regexp_extract(regexp_replace(upper(trim(raw)), '^[-*#:\\t ]+', ''), '^(EXECUTE|VERIFY|CONFIRM|AVOID)([^A-Z_]|$)', 1), '') AS decision
FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '** confirm it ' WHEN 1 THEN 'EXECUTED ' ELSE '- avoid: ' END || text AS raw FROM conversations)""")
def decision_parse(spark, sf_dir):
    """PRJ3, STR10: leading decision words."""
    t = table(spark, sf_dir, "conversations")
    raw = F.concat(F.when(F.col("turn") % 4 == 0, "** confirm it ").when(F.col("turn") % 4 == 1, "EXECUTED ").otherwise("- avoid: "), F.col("text"))
    return t.select("conv_id", "turn", S.decision_token(raw).alias("decision"))


@query("""WITH t AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '<a>x<b>y<c>' WHEN 1 THEN '<b>x<a>y<c>' ELSE '<a><a><c>' END AS s FROM conversations)
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN 'order' ELSE 'count:<a>,count:<b>' END AS errors FROM t""")
def tag_errors(spark, sf_dir):
    """STR11, VAL10: cardinality and order of tags."""
    t = table(spark, sf_dir, "conversations")
    text = F.when(F.col("turn") % 3 == 0, "<a>x<b>y<c>").when(F.col("turn") % 3 == 1, "<b>x<a>y<c>").otherwise("<a><a><c>")
    return t.select("conv_id", "turn", F.array_join(X.tag_errors(text, ["<a>", "<b>", "<c>"]), ",").alias("errors"))


@query("""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS name, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>'), 1) - 1 AS pos FROM pages),
s AS (SELECT *, substr(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48) AS slug FROM a)
SELECT page_id, CAST(pos AS INT) AS pos, href, name, 'click:link:' || CASE WHEN slug = '' THEN CAST(pos AS VARCHAR) ELSE slug END AS click FROM s""")
def page_controls(spark, sf_dir):
    """STR5, STR6, PRJ22: controls of pages with canonical clicks."""
    t = X.page_links(table(spark, sf_dir, "pages"), "page_id", "html")
    return t.withColumn("click", X.canonical_click(F.lit("link"), F.col("name"), F.col("pos").cast("string")))


@query("""WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), n AS (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) AS line FROM x)
SELECT doc_id, count(*) AS lines, count(*) FILTER (length(trim(raw, ' ')) > 0) AS filled, max(length(raw)) AS longest FROM n GROUP BY doc_id""")
def line_entities(spark, sf_dir):
    """Lines of texts that name an entity."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("raw"))
    return t.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(F.length(F.trim("raw")) > 0).alias("filled"), F.max(F.length("raw")).cast("long").alias("longest"))


@query(r"SELECT doc_id, regexp_matches(lower(text), '(^|[^a-z0-9])of[\t\n\r ]+the($|[^a-z0-9])') AS present FROM documents")
def phrase_boundary(spark, sf_dir):
    """PRED2, PRED3: a phrase at borders of letters and digits."""
    return table(spark, sf_dir, "documents").select("doc_id", S.phrase_present(F.col("text"), "of the").alias("present"))


@query("""SELECT conv_id, turn, CASE WHEN contains(t, 'open tab') OR contains(t, 'across the tabs') OR contains(t, 'opened tabs') THEN 'infeasible/multi-tab' WHEN contains(t, 'add to cart') OR contains(t, 'add to the cart') OR contains(t, ' to the shopping cart') THEN 'cart/add'
  WHEN contains(t, 'address') OR contains(t, 'my account') THEN 'account/address' WHEN contains(t, 'checkout') OR contains(t, 'place order') OR contains(t, 'purchase') OR contains(t, 'cancel') THEN 'order/checkout'
  WHEN contains(t, 'review') OR contains(t, 'rating') OR contains(t, 'comment') THEN 'review-QA' ELSE 'other-info' END AS bucket
FROM (SELECT conv_id, turn, lower(CASE turn % 5 WHEN 0 THEN 'Add to Cart ' WHEN 1 THEN 'cancel, in opened tabs ' WHEN 2 THEN 'rating of my account ' WHEN 3 THEN 'Comment: ' ELSE '' END || text) AS t FROM conversations)""")
def intent_buckets(spark, sf_dir):
    """PRJ20, PRJ21: the first matching group of keywords."""
    t, k = table(spark, sf_dir, "conversations"), F.col("turn") % 5
    said = F.concat(F.when(k == 0, "Add to Cart ").when(k == 1, "cancel, in opened tabs ").when(k == 2, "rating of my account ").when(k == 3, "Comment: ").otherwise(""), F.col("text"))
    return t.select("conv_id", "turn", S.intent_bucket(said).alias("bucket"))


@query("""WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark),
s AS (SELECT item_id, list_distinct(CASE WHEN len(w) < 4 THEN w ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w)
SELECT a.item_id AS a, b.item_id AS b, round(1 - len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS distance, round(1 - len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) <= 0.05 AS restored FROM s a JOIN s b ON b.item_id = a.item_id + 1""")
def shingle_jaccard(spark, sf_dir):
    """STR2, STR3, SET5, PRED5: distances of neighbouring states, and whether they count as restored."""
    t = table(spark, sf_dir, "benchmark").select("item_id", S.word_shingles(F.col("text")).alias("s"))
    p = t.select(F.col("item_id").alias("a"), F.col("s").alias("x"), (F.col("item_id") + 1).alias("b")).join(t.select(F.col("item_id").alias("b"), F.col("s").alias("y")), "b")
    distance = F.round(S.jaccard_distance(F.col("x"), F.col("y")), 6)
    return p.select("a", "b", distance.alias("distance"), (distance <= 0.05).alias("restored"))


@query("""SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, split_part(url, '/', len(string_split(url, '/'))) AS tail FROM pages""")
def url_parts(spark, sf_dir):
    """PRJ18, PRJ19, STR14: origin and tail of addresses."""
    return table(spark, sf_dir, "pages").select("page_id", F.parse_url("url", F.lit("PROTOCOL")).alias("scheme"), F.parse_url("url", F.lit("AUTHORITY")).alias("host"), F.substring_index("url", "/", -1).alias("tail"))


@query("SELECT event_id, sha256('{\"k\":' || json_extract_string(props, '$.k') || '}') AS sha FROM events")
def canonical_json(spark, sf_dir):
    """HSH1, STR23: digests of JSON with sorted keys and no spaces."""
    return table(spark, sf_dir, "events").select("event_id", S.sha256(S.canonical_json(F.col("props"))).alias("sha"))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '…' ELSE text END AS clipped FROM documents")
def clipped(spark, sf_dir):
    """PRJ16: clipped texts."""
    return table(spark, sf_dir, "documents").select("doc_id", S.clip(F.col("text"), 80).alias("clipped"))


@query("""SELECT o_orderkey, variant, o_orderstatus || ':' || variant AS rejected FROM orders, (VALUES ('false_safe', 'F'), ('over_block', 'O'), ('wrong_reversibility', 'P')) AS v(variant, skip) WHERE o_orderstatus <> skip""")
def pair_variants(spark, sf_dir):
    """PRJ14: one row becomes several rejected variants."""
    s = F.col("o_orderstatus")
    variants = [F.when(s != skip, F.lit(name)) for name, skip in (("false_safe", "F"), ("over_block", "O"), ("wrong_reversibility", "P"))]
    t = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.explode(F.array_compact(F.array(*variants))).alias("variant"))
    return t.select("o_orderkey", "variant", F.concat_ws(":", "o_orderstatus", "variant").alias("rejected"))


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS channels, count(DISTINCT event_type) AS n FROM events GROUP BY user_id")
def changed_channels(spark, sf_dir):
    """STR19, ARR1: sorted distinct values."""
    t = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("c"))
    return t.select("user_id", F.array_join("c", ",").alias("channels"), F.size("c").cast("long").alias("n"))


@query()
def parsed_actions(spark, sf_dir):
    """STR9, STR17: literal calls parsed in Arrow batches."""
    t = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("click('"), F.col("event_id").cast("string"), F.lit("')")).alias("action"))
    return X.parsed_actions(t, "event_id", "action")
