"""Queries on leakage-free splits: documents are linked by their long lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyloom.functions import scalars as S
from tallyloom.operators import splits as G
from tallyloom.plans.registry import query, table

_EDGES = """WITH RECURSIVE lines AS (SELECT DISTINCT doc_id AS id, sha256('lines:' || l) AS value FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE length(l) >= 40),
low AS (SELECT value, min(id) AS low FROM lines GROUP BY value), edges AS (SELECT DISTINCT id AS u, low AS v FROM lines JOIN low ON lines.value = low.value WHERE id <> low),
sides AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges), reach(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT s.v, r.root FROM reach r JOIN sides s ON r.node = s.u AND r.root < s.v),
comp AS (SELECT node AS id, min(root) AS component FROM reach GROUP BY node),
report AS (SELECT component, count(*) AS size, min(id) AS first_id, sha256(string_agg(CAST(id AS VARCHAR), chr(10) ORDER BY CAST(id AS VARCHAR))) AS ids_sha256 FROM comp GROUP BY component),
placed AS (SELECT *, row_number() OVER (ORDER BY ids_sha256 DESC, first_id DESC) AS place, count(*) OVER () AS n FROM report),
parted AS (SELECT id, c.component, CASE WHEN n < 2 THEN NULL WHEN place <= least(greatest(1, floor(n * 0.2)), n - 1) THEN 'test' ELSE 'train' END AS side FROM comp c JOIN placed p ON c.component = p.component)
"""


def _values(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents")
    t = d.select("doc_id", F.filter(F.split("text", "\n"), lambda x: F.length(x) >= 40).alias("lines"))
    return G.axis_values(t, "doc_id", ["lines"]), d.select(F.col("doc_id").alias("id"))


def _components(spark, sf_dir) -> DataFrame:
    return G.isolation_components(*_values(spark, sf_dir))


@query(_EDGES + "SELECT id, component FROM comp")
def isolation_components(spark, sf_dir):
    """GRF1: rows that share a value, directly or through others."""
    return _components(spark, sf_dir)


@query(_EDGES + "SELECT component, size, first_id, ids_sha256, 'component-' || substr(ids_sha256, 1, 16) AS component_id FROM report")
def component_report(spark, sf_dir):
    """GRF2, SRT1: components with content-derived ids."""
    return G.component_report(_components(spark, sf_dir))


@query(_EDGES + "SELECT id, component, side FROM parted")
def strict_split(spark, sf_dir):
    """GRF4, GRF5: whole components held out."""
    return G.strict_partition(_components(spark, sf_dir), 0.2)


@query(_EDGES + """, v AS (SELECT 'lines' AS axis, value, side FROM lines JOIN parted ON lines.id = parted.id), x AS (SELECT axis, value, bool_or(side = 'train') AS a, bool_or(side = 'test') AS b FROM v GROUP BY 1, 2)
SELECT axis, count(*) FILTER (a) AS n_train, count(*) FILTER (b) AS n_test, count(*) FILTER (a AND b) AS n_overlap FROM x GROUP BY axis""")
def leakage_audit(spark, sf_dir):
    """SET1, GRF11: values that both sides have; none after a strict split."""
    values, ids = _values(spark, sf_dir)
    return G.leakage(values, G.strict_partition(G.isolation_components(values, ids), 0.2))


@query("WITH v AS (SELECT source, row_number() OVER (ORDER BY source DESC) AS p, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)) SELECT doc_id, d.source, CASE WHEN p <= least(greatest(1, floor(n * 0.2)), n - 1) THEN 'test' ELSE 'train' END AS side FROM documents d JOIN v ON d.source = v.source")
def holdout_split(spark, sf_dir):
    """GRF10, SRT2: the last values of an axis held out."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return G.challenge(d, "source", [], G.holdout_values(d, "source", 0.2))


_CHALLENGE = """WITH o AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus FROM orders),
r AS (SELECT o_orderpriority, row_number() OVER (ORDER BY count(DISTINCT o_custkey), o_orderpriority) AS p, count(*) OVER () AS n FROM o GROUP BY 1),
held AS (SELECT o_orderpriority FROM r WHERE n >= 2 AND p <= least(greatest(1, floor(n * 0.2)), n - 1)),
test AS (SELECT * FROM o WHERE o_orderpriority IN (SELECT * FROM held))
"""


@query(_CHALLENGE + "SELECT o_orderkey, 'test' AS side FROM test UNION ALL SELECT o_orderkey, 'train' FROM o WHERE o_orderpriority NOT IN (SELECT * FROM held) AND o_custkey NOT IN (SELECT o_custkey FROM test)")
def challenge_split(spark, sf_dir):
    """GRF6, GRF7, SRT3: one axis held out, train rows that touch its entities dropped."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    held = G.holdout_values(o, "o_orderpriority", 0.2, by_entities="o_custkey")
    return G.challenge(o, "o_orderpriority", ["o_custkey"], held).select("o_orderkey", "side")


@query("SELECT source, count(DISTINCT lang) AS places, count(*) AS n FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1")
def template_bridges(spark, sf_dir):
    """GRF3: templates in more than one environment."""
    return G.bridges(table(spark, sf_dir, "documents"), "source", "lang")


@query("""SELECT c_custkey, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 41), lambda i: CAST(instr('0123456789abcdef', substr(sha1(c_name), i, 1)) - 1 AS BIGINT))), lambda a, b: (a * 16 + b) % 1000) < 100 AS validation FROM customer""")
def hash_split(spark, sf_dir):
    """STAT6, HSH2: stable validation by a hash of the entity."""
    return table(spark, sf_dir, "customer").select("c_custkey", G.hashed_validation(F.col("c_name"), 0.1).alias("validation"))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def pairs_for_train(spark, sf_dir):
    """JN10: rows whose source is in train."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")


_SHINGLES = """regexp_extract_all(lower({c}), '[a-z0-9]+')"""


@query("""WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark), d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
bs AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) < 8 THEN w ELSE list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')) END) AS s FROM b),
ds AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 8 THEN w ELSE list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')) END) AS s FROM d)
SELECT doc_id, count(DISTINCT s) AS shared FROM ds WHERE s IN (SELECT s FROM bs) GROUP BY doc_id""")
def held_out_overlap(spark, sf_dir):
    """SET1 on shingles: training texts that share runs of words with a held-out table."""
    of = lambda n, k: table(spark, sf_dir, n).select(k, F.explode(S.word_shingles(F.col("text"), 8)).alias("s"))
    held = of("benchmark", "item_id").select(F.sha2(F.col("s").cast("binary"), 256).alias("h")).distinct()
    rows = of("documents", "doc_id").select("doc_id", F.sha2(F.col("s").cast("binary"), 256).alias("h"))
    return rows.join(held, "h", "left_semi").groupBy("doc_id").agg(F.count("*").alias("shared"))
