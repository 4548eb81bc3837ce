"""Queries on rates, classification, calibration, rewards and quality. Documents stand for episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyloom.functions import scalars as S
from tallyloom.operators import matrix, metrics as M
from tallyloom.plans.registry import query, table

EPISODES = """
WITH ep AS (
  SELECT d.doc_id, d.lang, d.source, d.n_chars, l.toxic = 1 AS risk, coalesce(l.quality = 0, false) AS violates, d.n_chars % 3 = 0 AS required,
         CASE d.n_chars % 6 WHEN 0 THEN 'EXECUTE' WHEN 1 THEN 'CONFIRM' WHEN 2 THEN 'AVOID' WHEN 3 THEN 'VERIFY' WHEN 5 THEN 'EXECUTE' END AS decision,
         CASE WHEN d.n_chars % 5 = 0 THEN NULL ELSE d.n_chars % 5 <= 2 END AS attempt,
         CASE WHEN d.n_chars % 7 = 0 THEN NULL ELSE d.n_chars % 2 = 0 END AS legal,
         l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""
_WILSON = """
  greatest(0.0, (num / den + {z2} / (2 * den)) / (1 + {z2} / den) - {z} * sqrt((num / den * (1 - num / den) + {z2} / (4 * den)) / den) / (1 + {z2} / den))""".format(z=S.Z95, z2=S.Z95 * S.Z95)
_WILSON_HIGH = _WILSON.replace("greatest(0.0,", "least(1.0,").replace("- {z}".format(z=S.Z95), "+ {z}".format(z=S.Z95))


def episodes(spark, sf_dir) -> DataFrame:
    """Documents with labels as episodes: tri-state truth, declared decision, attempt and legality."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    t = d.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    n = F.col("n_chars")
    raw = F.when(n % 6 == 0, "- **EXECUTE").when(n % 6 == 1, "CONFIRM").when(n % 6 == 2, "avoid: never").when(n % 6 == 3, "# VERIFY").when(n % 6 == 5, "EXECUTE")
    return t.withColumns(
        {
            "risk": F.col("toxic") == 1,
            "violates": F.coalesce(F.col("quality") == 0, F.lit(False)),
            "required": n % 3 == 0,
            "decision": S.decision_token(raw),
            "attempt": F.when(n % 5 != 0, n % 5 <= 2),
            "legal": F.when(n % 7 != 0, n % 2 == 0),
        }
    )


def rules():
    c = F.col
    danger = c("violates") | c("risk")
    safe = ~c("violates") & ~c("risk")
    known = c("attempt").isNotNull() & ((~c("attempt")) | c("legal").isNotNull())
    return [
        ("FSR-declaration", danger, c("decision") == "EXECUTE", c("decision").isNotNull()),
        ("FSR-attempt", danger, c("attempt") & c("legal"), known),
        ("FBR", safe & c("required"), c("decision") != "EXECUTE", c("decision").isNotNull()),
        ("violation-attempt", c("violates"), c("attempt"), c("attempt").isNotNull()),
    ]


_RATES = """, flat AS (
  SELECT lang, doc_id, 'FSR-declaration' AS metric, coalesce(violates OR risk, false) AS d, decision = 'EXECUTE' AS u, decision IS NOT NULL AS o FROM ep
  UNION ALL SELECT lang, doc_id, 'FSR-attempt', coalesce(violates OR risk, false), attempt AND legal, attempt IS NOT NULL AND (NOT attempt OR legal IS NOT NULL) FROM ep
  UNION ALL SELECT lang, doc_id, 'FBR', coalesce(NOT violates AND NOT risk AND required, false), decision <> 'EXECUTE', decision IS NOT NULL FROM ep
  UNION ALL SELECT lang, doc_id, 'violation-attempt', violates, attempt, attempt IS NOT NULL FROM ep),
sums AS (
  SELECT lang, metric, count(*) FILTER (d AND o AND u) AS num, count(*) FILTER (d) AS den, count(*) FILTER (d AND o) AS obs,
         coalesce(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (d AND o AND u), '') AS numerator_ids,
         coalesce(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (d AND NOT o), '') AS unknown_ids
  FROM flat GROUP BY lang, metric)
"""


@query(EPISODES + _RATES + f"""
SELECT lang, metric, num AS numerator, den AS denominator, obs AS observed_count, numerator_ids, unknown_ids, obs = den AS complete,
  round(CASE WHEN obs = den AND den > 0 THEN num / den END, 9) AS rate, round(CASE WHEN den > 0 THEN num / den END, 9) AS lower_bound,
  round(CASE WHEN den > 0 THEN (num + den - obs) / den END, 9) AS upper_bound, round(CASE WHEN obs > 0 THEN num / obs END, 9) AS observed_rate,
  round(CASE WHEN obs = den AND den > 0 THEN {_WILSON} END, 9) AS wilson_low, round(CASE WHEN obs = den AND den > 0 THEN {_WILSON_HIGH} END, 9) AS wilson_high
FROM sums""")
def rate_suite(spark, sf_dir):
    """AGG1, AGG2, STAT1, PRJ8: auditable rates per language with ids and bounds."""
    t = M.rates(episodes(spark, sf_dir), ["lang"], rules(), "doc_id")
    numbers = ["rate", "lower_bound", "upper_bound", "observed_rate", "wilson_low", "wilson_high"]
    return t.withColumns({c: F.round(c, 9) for c in numbers})


@query(EPISODES + _RATES + """
SELECT lang, metric, num AS numerator, den AS denominator, round(CASE WHEN den >= 30 AND obs = den THEN num / den END, 9) AS rate,
  den >= 30 AND obs = den AS claimable, CASE WHEN den < 30 THEN 'denominator<30' END AS blocked_reason FROM sums""")
def small_cell_gate(spark, sf_dir):
    """AGG3: rates of small cells are withheld."""
    t = M.gate_small_cells(M.rates(episodes(spark, sf_dir), ["lang"], rules(), "doc_id", with_ids=False))
    return t.select("lang", "metric", "numerator", "denominator", F.round("rate", 9).alias("rate"), "claimable", "blocked_reason")


_CLASSES = """, p AS (
  SELECT CASE n_chars % 4 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'RECOVERED' WHEN 2 THEN 'PARTIALLY_RECOVERED' ELSE 'NOT_RECOVERED_WITHIN_BUDGET' END AS truth,
         CASE doc_id % 5 WHEN 0 THEN 'RECOVERED' WHEN 1 THEN 'RECOVERED' WHEN 2 THEN 'NOT_RECOVERED_WITHIN_BUDGET' WHEN 3 THEN 'PARTIALLY_RECOVERED' ELSE 'UNKNOWN' END AS guess FROM ep),
s AS (SELECT c.class, count(*) FILTER (truth = c.class AND guess = c.class) AS tp, count(*) FILTER (truth <> c.class AND guess = c.class) AS fp,
             count(*) FILTER (truth = c.class AND guess <> c.class) AS fn, count(*) FILTER (truth = c.class) AS support
      FROM p CROSS JOIN (VALUES ('RECOVERED'), ('PARTIALLY_RECOVERED'), ('NOT_RECOVERED_WITHIN_BUDGET')) AS c(class) WHERE truth <> 'UNKNOWN' GROUP BY c.class),
r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall FROM s)
"""


def predictions(spark, sf_dir):
    t = episodes(spark, sf_dir)
    n, i = F.col("n_chars") % 4, F.col("doc_id") % 5
    truth = F.when(n == 0, "no idea").when(n == 1, " reversible_with_cost").when(n == 2, "PARTIALLY_RECOVERABLE").otherwise("IRREVERSIBLE")
    guess = F.when(i == 0, "RECOVERED").when(i == 1, "REVERSIBLE").when(i == 2, "irreversible").when(i == 3, "PARTIALLY_RECOVERED").otherwise("NO_EFFECT")
    return t.withColumns({"truth": S.recovery_status(truth), "guess": S.recovery_status(guess)})


@query(EPISODES + _CLASSES + "SELECT class, tp, fp, fn, support, round(precision, 9) AS precision, round(recall, 9) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 9) AS f1 FROM r")
def classification_report(spark, sf_dir):
    """AGG4, PRJ1: precision, recall and F1 over canonical recovery classes."""
    t = M.classification(predictions(spark, sf_dir), "truth", "guess", S.RECOVERY_CLASSES)
    return t.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


_PROBABLE = """, q AS (SELECT doc_id, toxic = 1 AS truth, least(1.0, n_chars / 8000.0) AS p FROM ep WHERE toxic IS NOT NULL)
"""


def probabilities(spark, sf_dir):
    t = episodes(spark, sf_dir).where("toxic IS NOT NULL")
    return t.select("doc_id", F.col("risk").alias("truth"), F.least(F.lit(1.0), F.col("n_chars") / 8000.0).alias("p"))


@query(EPISODES + _PROBABLE + """, b AS (SELECT least(9, CAST(floor(p * 10) AS INT)) AS bin, count(*) AS n, avg(p) AS mp, avg(CAST(truth AS INT)) AS f FROM q GROUP BY 1)
SELECT CAST(r.range AS INT) AS bin, coalesce(n, 0) AS n, round(mp, 9) AS mean_probability, round(f, 9) AS event_frequency FROM range(10) r LEFT JOIN b ON r.range = b.bin""")
def ece_bins(spark, sf_dir):
    """AGG5: calibration bins, empty ones kept."""
    t = M.calibration_bins(probabilities(spark, sf_dir), "p", "truth")
    return t.select("bin", "n", F.round("mean_probability", 9).alias("mean_probability"), F.round("event_frequency", 9).alias("event_frequency"))


@query(EPISODES + _PROBABLE + """, b AS (SELECT least(9, CAST(floor(p * 10) AS INT)) AS bin, count(*) AS n, avg(p) AS mp, avg(CAST(truth AS INT)) AS f FROM q GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(mp - f)) / sum(n), 9) AS ece FROM b""")
def ece(spark, sf_dir):
    """AGG5: expected calibration error."""
    t = M.expected_calibration_error(M.calibration_bins(probabilities(spark, sf_dir), "p", "truth"))
    return t.select("n", F.round("ece", 9).alias("ece"))


@query(EPISODES + _PROBABLE + "SELECT count(*) AS n, round(avg(pow(p - CAST(truth AS INT), 2)), 9) AS brier FROM q")
def brier(spark, sf_dir):
    """AGG6: Brier score."""
    return M.brier(probabilities(spark, sf_dir), "p", "truth").select("n", F.round("brier", 9).alias("brier"))


@query(EPISODES + _PROBABLE + """, k AS (SELECT *, row_number() OVER (ORDER BY abs(p - 0.5) DESC, doc_id) AS r, count(*) OVER () AS total, (p >= 0.5) <> truth AS wrong FROM q),
c AS (SELECT DISTINCT asked, CAST(ceil(total * asked) AS BIGINT) AS n, total FROM k, (VALUES (0.25::DOUBLE), (0.5), (0.75), (1.0)) AS v(asked))
SELECT c.asked, c.n, round(c.n / c.total, 9) AS coverage, round(count(*) FILTER (wrong) / c.n, 9) AS risk, count(*) FILTER (wrong) AS errors FROM c JOIN k ON k.r <= c.n GROUP BY c.asked, c.n, c.total""")
def risk_coverage(spark, sf_dir):
    """AGG7: risk at four coverages."""
    t = M.risk_coverage(probabilities(spark, sf_dir), "p", "truth", "doc_id")
    return t.select("asked", "n", F.round("coverage", 9).alias("coverage"), F.round("risk", 9).alias("risk"), "errors")


@query(EPISODES + """, m AS (SELECT abs(n_chars % 17 - n_chars % 13) AS cost, quality = 1 AS ok, toxic = 1 AS bad FROM ep WHERE quality IS NOT NULL)
SELECT round(avg(cost), 9) AS undo_cost_mae, count(*) FILTER (ok) AS task_success, count(*) FILTER (ok AND NOT bad) AS cup, count(*) AS n FROM m""")
def task_metrics(spark, sf_dir):
    """AGG8: mean absolute cost error, task success, and success without violation."""
    t = episodes(spark, sf_dir).where("quality IS NOT NULL")
    ok, bad, n = F.col("quality") == 1, F.col("toxic") == 1, F.col("n_chars")
    return t.agg(F.round(F.avg(F.abs(n % 17 - n % 13)), 9).alias("undo_cost_mae"), F.count_if(ok).alias("task_success"), F.count_if(ok & ~bad).alias("cup"), F.count("*").alias("n"))


@query(EPISODES + """, k AS (SELECT *, row_number() OVER (ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS r, count(*) OVER () AS total FROM ep WHERE toxic IS NOT NULL),
f AS (SELECT noise, decision, CASE WHEN r <= round_even(noise * total, 0) THEN NOT risk ELSE risk END AS risk FROM k, (VALUES (0.0::DOUBLE), (0.05), (0.10), (0.20)) AS v(noise))
SELECT noise, count(*) FILTER (risk) AS denominator, count(*) FILTER (risk AND decision = 'EXECUTE') AS numerator FROM f GROUP BY noise""")
def noise_sensitivity(spark, sf_dir):
    """STAT5: false-safe counts after flipping labels of the smallest hashes."""
    t = episodes(spark, sf_dir).where("toxic IS NOT NULL").select("doc_id", "risk", "decision")
    total, out = t.count(), None
    for noise in (0.0, 0.05, 0.10, 0.20):
        part = M.flip_noise(t, "doc_id", "risk", noise, total)
        part = part.agg(F.lit(noise).alias("noise"), F.count_if("risk").alias("denominator"), F.count_if(F.col("risk") & (F.col("decision") == "EXECUTE")).alias("numerator"))
        out = part if out is None else out.unionByName(part)
    return out


@query(EPISODES + """, s AS (SELECT source AS cluster, count(*) FILTER (risk) AS d, count(*) FILTER (risk AND decision = 'EXECUTE') AS u FROM ep GROUP BY source),
c AS (SELECT *, row_number() OVER (ORDER BY cluster) - 1 AS pos, count(*) OVER () AS n FROM s),
g AS (SELECT b.range AS b, CAST('0x' || substr(md5('7:' || b.range || ':' || i.range), 1, 13) AS BIGINT) % (SELECT count(*) FROM s) AS pos FROM range(200) b, range((SELECT count(*) FROM s)) i),
r AS (SELECT b, sum(u) / nullif(sum(d), 0) AS rate FROM g JOIN c ON g.pos = c.pos GROUP BY b),
k AS (SELECT rate, row_number() OVER (ORDER BY rate NULLS FIRST) - 1 AS k FROM r)
SELECT (SELECT count(*) FROM s) AS clusters, round(max(rate) FILTER (k = 4), 9) AS low, round(max(rate) FILTER (k = 194), 9) AS high FROM k""")
def cluster_bootstrap(spark, sf_dir):
    """STAT3, STAT4, AGG32: percentile interval from resampled clusters with hashed draws."""
    t = M.cluster_bootstrap(episodes(spark, sf_dir), ["source"], F.coalesce("risk", F.lit(False)), F.col("decision") == "EXECUTE", 200, 7)
    return t.select("clusters", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query("SELECT coalesce(lang, '<missing>') AS lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def distribution(spark, sf_dir):
    """AGG9, AGG10: counts by value, missing ones in a bucket of their own."""
    return table(spark, sf_dir, "documents").groupBy(F.coalesce("lang", F.lit("<missing>")).alias("lang"), "source").agg(F.count("*").alias("n"))


@query("WITH t AS (SELECT source, count(DISTINCT lang) AS kinds, count(*) AS n FROM documents GROUP BY source) SELECT kinds, count(*) AS sources, CAST(sum(n) AS BIGINT) AS rows FROM t GROUP BY kinds")
def counterfactual_coverage(spark, sf_dir):
    """AGG11, AGG18, AGG20: distinct kinds per group, and a histogram of them."""
    t = table(spark, sf_dir, "documents").groupBy("source").agg(F.count_distinct("lang").alias("kinds"), F.count("*").alias("n"))
    return t.groupBy("kinds").agg(F.count("*").alias("sources"), F.sum("n").alias("rows"))


@query(EPISODES + """SELECT count(*) FILTER (quality = 0 AND violates) AS tp, count(*) FILTER (toxic = 1 AND quality = 1) AS fp, count(*) FILTER (quality = 0 AND toxic = 0) AS fn,
  string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (toxic = 1) AS positive_ids FROM ep WHERE quality IS NOT NULL""")
def confusion(spark, sf_dir):
    """AGG14: confusion counts with sorted ids."""
    t = episodes(spark, sf_dir).where("quality IS NOT NULL")
    q, x = F.col("quality"), F.col("toxic")
    return t.agg(F.count_if((q == 0) & F.col("violates")).alias("tp"), F.count_if((x == 1) & (q == 1)).alias("fp"), F.count_if((q == 0) & (x == 0)).alias("fn"), S.ids_text(F.col("doc_id"), x == 1).alias("positive_ids"))


@query("""SELECT role, count(*) AS n, round(quantile_cont(length(text), 0.5), 6) AS p50, round(quantile_cont(length(text), 0.95), 6) AS p95, CAST(quantile_disc(length(text), 0.95) AS BIGINT) AS nearest95,
  max(length(text)) AS longest, count(*) FILTER (length(text) > 400) AS over_limit FROM conversations GROUP BY role""")
def length_percentiles(spark, sf_dir):
    """AGG23, AGG24, AGG34: exact linear and nearest-rank percentiles of lengths per role."""
    t = table(spark, sf_dir, "conversations").select("role", F.length("text").cast("long").alias("size"))
    return t.groupBy("role").agg(
        F.count("*").alias("n"),
        F.round(F.percentile("size", F.lit(0.5)), 6).alias("p50"),
        F.round(F.percentile("size", F.lit(0.95)), 6).alias("p95"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY size)").cast("long").alias("nearest95"),
        F.max("size").alias("longest"),
        F.count_if(F.col("size") > 400).alias("over_limit"),
    )


@query(EPISODES + """SELECT doc_id, CASE WHEN violates THEN 'AVOID' WHEN risk THEN 'CONFIRM' WHEN NOT risk THEN 'EXECUTE' WHEN n_chars % 4 IN (2, 3) THEN 'CONFIRM' WHEN required AND n_chars % 4 = 0 THEN 'VERIFY' ELSE 'EXECUTE' END AS decision,
  round(CASE WHEN violates AND risk THEN 0.95 WHEN violates THEN 0.8 WHEN risk THEN 0.9 WHEN NOT risk THEN 0.1 WHEN required AND n_chars % 4 = 0 THEN 0.5 WHEN n_chars % 4 IN (2, 3) THEN 0.7 WHEN required THEN 0.1 ELSE 0.15 END, 4) :: DOUBLE AS score FROM ep""")
def policy_oracle(spark, sf_dir):
    """PRJ10: decision and score from constraint, risk and recoverability."""
    t = predictions(spark, sf_dir)
    said = S.policy_decision(F.col("truth"), F.col("violates"), F.col("required"), F.col("risk"))
    return t.select("doc_id", said["decision"].alias("decision"), F.round(said["score"], 4).alias("score"))


@query(EPISODES + """, w AS (SELECT doc_id, CASE WHEN decision IS NULL THEN 0.0 ELSE 0.2 END + CASE WHEN decision = CASE WHEN risk THEN 'CONFIRM' ELSE 'EXECUTE' END THEN 0.4 ELSE 0.0 END
  + CASE WHEN violates AND decision = 'EXECUTE' THEN -1.0 ELSE 0.0 END AS r FROM ep)
SELECT doc_id, round(r, 6) :: DOUBLE AS reward FROM w""")
def reward_scores(spark, sf_dir):
    """STAT7: weighted rewards for format, decision and safety."""
    t, c = episodes(spark, sf_dir), F.col
    gold = F.when(c("risk"), "CONFIRM").otherwise("EXECUTE")
    zero = F.lit(0.0)
    total = F.when(c("decision").isNull(), zero).otherwise(0.2) + F.when(c("decision") == gold, 0.4).otherwise(zero) + F.when(c("violates") & (c("decision") == "EXECUTE"), -1.0).otherwise(zero)
    return t.select("doc_id", F.round(total, 6).alias("reward"))


@query(EPISODES + "SELECT lang, CAST(count(*) FILTER (n_chars % 2 = 0) AS DOUBLE) / count(*) >= 0.5 AS passed, count(*) AS n FROM ep GROUP BY lang")
def deployment_share(spark, sf_dir):
    """AGG17, AGG29: share of one kind against a gate."""
    t = episodes(spark, sf_dir).groupBy("lang").agg(F.avg((F.col("n_chars") % 2 == 0).cast("double")).alias("s"), F.count("*").alias("n"))
    return t.select("lang", (F.col("s") >= 0.5).alias("passed"), "n")


_PAIRS = """, pr AS (SELECT doc_id, CASE WHEN quality IS NULL THEN 'UNKNOWN' WHEN quality = 1 THEN 'GOOD' ELSE 'BAD' END AS a, CASE n_chars % 3 WHEN 0 THEN 'GOOD' WHEN 1 THEN 'BAD' ELSE 'UNKNOWN' END AS b FROM ep)
"""


@query(EPISODES + _PAIRS + "SELECT a, b, count(*) AS n, a <> 'UNKNOWN' AND b <> 'UNKNOWN' AS comparable, a <> 'UNKNOWN' AND b <> 'UNKNOWN' AND a <> b AS disagrees FROM pr GROUP BY a, b")
def disagreement(spark, sf_dir):
    """PVT2, JN17: confusion of two label sources."""
    t = episodes(spark, sf_dir)
    a = F.when(F.col("quality").isNull(), "UNKNOWN").when(F.col("quality") == 1, "GOOD").otherwise("BAD")
    b = F.when(F.col("n_chars") % 3 == 0, "GOOD").when(F.col("n_chars") % 3 == 1, "BAD").otherwise("UNKNOWN")
    return matrix.disagreement(t.select(a.alias("a"), b.alias("b")), "a", "b", "UNKNOWN")


@query("SELECT source, max(n_chars) FILTER (lang = 'en') AS en, max(n_chars) FILTER (lang = 'de') AS de, max(n_chars) FILTER (lang = 'fr') AS fr, max(n_chars) FILTER (lang = 'es') AS es FROM documents GROUP BY source")
def rater_matrix(spark, sf_dir):
    """PVT1: cases by raters."""
    return matrix.rater_matrix(table(spark, sf_dir, "documents"), "source", "lang", ["en", "de", "fr", "es"], "n_chars")


@query("SELECT c_custkey, count(DISTINCT o_orderpriority) AS raters, count(*) AS ratings, count(DISTINCT o_orderpriority) < 2 AS under_rated FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey")
def rater_coverage(spark, sf_dir):
    """AGG19: distinct raters per case."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    return matrix.coverage(o.join(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey"), "c_custkey", "o_orderpriority")


@query("SELECT u.user_id, e.event_type FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events) e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = u.user_id AND x.event_type = e.event_type)")
def missing_cells(spark, sf_dir):
    """SET7: pairs without a rating."""
    return matrix.missing_cells(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("SELECT label, count(*) AS n, round(avg(len(embedding)), 6) AS dims FROM embeddings GROUP BY label")
def embedding_profile(spark, sf_dir):
    """AGG9 on vectors."""
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.size("embedding")), 6).alias("dims"))
