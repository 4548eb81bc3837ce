"""Operator 9: secret scan with corpus-wide ownership frequency. DataFrame functions only.

Three fixed patterns give base spans. Beside them, long tokens of letters and digits are
candidates: their hashes are aggregated over the corpus by distinct repositories and owners. A
value that many owners share is a copied example; one that few owners have looks live, and its
spans are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.session import bounded, fresh, materialize

# The three base patterns; letters of the keywords stand in either case.
KEYWORDS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = "(" + KEYWORDS + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "owned")

#: A candidate token: at least this long, with a letter and a digit, and not all hexadecimal.
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
#: A value in at most so many owners and repositories looks live.
MOST_OWNERS = 2
MOST_REPOSITORIES = 2
#: The added spans of so many documents at most are broadcast to the texts; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
MASK = "[SECRET]"
SPAN = "array<struct<s:bigint,kind:int,e:bigint,value:bigint>>"
#: Prefix sums add whole blocks of so many steps first, which keeps them far from quadratic.
BLOCK = 256


def _spans(text: str, pattern: str, kind: int, group: int, keep: str) -> str:
    """SQL for the spans of all leftmost non-overlapping matches that satisfy ``keep``.

    Matches and the gaps between them give every start as a prefix sum of lengths in code points.
    ``keep`` sees ``m`` (the match) and ``v`` (its group).
    """
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    found = f"regexp_extract_all({text}, '{quoted}', 0)"
    values = found if not group else f"regexp_extract_all({text}, '{quoted}', {group})"
    return f"""
      element_at(transform(array({found}), mm -> CASE WHEN size(mm) = 0 THEN cast(array() AS {SPAN}) ELSE
        element_at(transform(array(struct({values} AS vv, split({text}, '{quoted}', -1) AS gg)), t ->
        element_at(transform(array(transform(mm, (m, i) -> cast(length(t.gg[i]) + IF(i = 0, 0, length(get(mm, i - 1))) AS bigint))), steps ->
        element_at(transform(array(transform(sequence(0, (size(steps) - 1) div {BLOCK}), b -> aggregate(slice(steps, cast(b AS int) * {BLOCK} + 1, {BLOCK}), 0L, (a, x) -> a + x))), sums ->
          filter(transform(mm, (m, i) -> IF({keep.replace('v!', 't.vv[i]')}, struct(
              aggregate(slice(sums, 1, cast(i div {BLOCK} AS int)), 0L, (a, x) -> a + x)
                + aggregate(slice(steps, cast(i div {BLOCK} AS int) * {BLOCK} + 1, i % {BLOCK} + 1), 0L, (a, x) -> a + x) AS s,
              {kind} AS kind, cast(length(m) AS bigint) AS e, xxhash64(t.vv[i]) AS value), NULL)), x -> x IS NOT NULL)), 1)), 1)), 1) END), 1)"""


def base_spans(text: str = "text") -> Column:
    """Array of (s, kind, e, value): all base spans of a text, null text as empty, by start then kind."""
    parts = [
        _spans("_t", ASSIGN, 0, 2, f"length(v!) >= {LEAST_ASSIGN}"),
        _spans("_t", ACCESS, 1, 0, f"length(m) >= {LEAST_ACCESS}"),
        _spans("_t", "[0-9a-f]{%d,}" % LEAST_HEX, 2, 0, "true"),
    ]
    return _ended(parts, text)


def candidate_spans(text: str = "text") -> Column:
    """Array like :func:`base_spans` with the long tokens whose value is judged by its owners."""
    keep = "m rlike '[A-Za-z]' AND m rlike '[0-9]' AND NOT m rlike '^[0-9a-f]+$'"
    return _ended([_spans("_t", CANDIDATE, 3, 0, keep)], text)


def _ended(parts: list[str], text: str) -> Column:
    joined = parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"
    sql = f"array_sort(transform({joined}, x -> struct(x.s AS s, x.kind AS kind, x.s + x.e AS e, x.value AS value)))"
    return F.expr(f"element_at(transform(array(coalesce({text}, '')), _t -> {sql}), 1)")


def row_key(*cols: str) -> list[Column]:
    """Two 64-bit hashes of a row; equal rows share them and have equal results."""
    return [F.xxhash64(*cols).alias("k1"), F.xxhash64(F.lit("second"), *cols).alias("k2")]


def live_values(candidates: DataFrame) -> DataFrame:
    """Values (hash) of (value, owner, repository) rows that few owners and repositories have."""
    places = candidates.select("value", "owner", "repository").distinct()
    owners = places.groupBy("value", "owner").agg(F.count("*").alias("repositories"))
    spread = owners.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    return spread.where((F.col("owners") <= MOST_OWNERS) & (F.col("repositories") <= MOST_REPOSITORIES)).select("value")


def scan(docs: DataFrame, owner: str = "source", repository: str = "source") -> DataFrame:
    """One row per document: (k1, k2, doc_id, base, added), arrays of spans.

    ``docs`` needs doc_id, text and the two columns named; others are ignored. Null texts are
    empty; null owners count as one owner. Repeated rows give repeated, equal results. An empty
    table gives an empty table.
    """
    key = ["doc_id", owner, repository, "text"]
    found = docs.select(*row_key(*key), "doc_id", F.col(owner).alias("owner"), F.col(repository).alias("repository"), base_spans().alias("base"), candidate_spans().alias("more"))
    found = materialize(found, "secrets")
    rows = found.where(F.size("more") > 0).select("k1", "k2", "owner", "repository", F.explode("more").alias("x")).select("k1", "k2", "owner", "repository", "x", F.col("x.value").alias("value"))
    live = bounded(materialize(live_values(rows), "live-values"), BROADCAST_ROWS)
    added = rows.join(live, "value", "left_semi").groupBy("k1", "k2").agg(F.array_sort(F.collect_set("x")).alias("added"))
    added = materialize(added, "added-spans")
    return found.join(added, ["k1", "k2"], "left").select("k1", "k2", "doc_id", "base", F.coalesce("added", F.expr(f"cast(array() AS {SPAN})")).alias("added"))


def told(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"], x["e"])), ",")


def redact(docs: DataFrame, owner: str = "source", repository: str = "source") -> DataFrame:
    """``docs`` with every found span replaced by a mask and n_chars, if there, set anew.

    Overlapping spans become one mask; texts without spans, nulls included, stay as they are.
    Repeated rows get equal texts; null ids and owners are values like others. Very long texts go
    through whole. An empty table stays empty; extra columns of any name come back unchanged.
    """
    names = docs.columns
    k1, k2, base, extra, spans = fresh(names, "k1", "k2", "base", "extra", "spans")
    added = scan(docs, owner, repository).where(F.size("added") > 0).groupBy("k1", "k2").agg(F.first("added").alias("added"))
    added = bounded(materialize(added, "masked-spans"), BROADCAST_ROWS).withColumnsRenamed({"k1": k1, "k2": k2, "added": extra})
    key = [k.alias(n) for n, k in zip((k1, k2), row_key("doc_id", owner, repository, "text"))]
    t = docs.select("*", *key, base_spans().alias(base)).join(added, [k1, k2], "left")
    t = t.withColumn(spans, F.array_sort(F.concat(base, F.coalesce(extra, F.expr(f"cast(array() AS {SPAN})")))))
    masked = F.expr(f"""
      aggregate({spans}, struct(0L AS pos, cast(array() AS array<string>) AS parts),
        (a, x) -> CASE WHEN x.s >= a.pos THEN struct(x.e AS pos, concat(a.parts, array(substring(text, cast(a.pos + 1 AS int), cast(x.s - a.pos AS int)), '{MASK}')) AS parts)
                       ELSE struct(greatest(a.pos, x.e) AS pos, a.parts AS parts) END,
        a -> concat(array_join(a.parts, ''), substring(text, cast(a.pos + 1 AS int))))""")
    t = t.withColumn("text", F.when(F.size(spans) > 0, masked).otherwise(F.col("text")))
    if "n_chars" in names:
        t = t.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return t.select(*names)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan all documents."""
    t = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    every = F.array_sort(F.concat("base", "added"))
    return t.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(every).alias("spans"))


# Starts are running sums over the unnested matches and the gaps before them.
_ORACLE_KIND = """
  SELECT row, doc_id, source, {kind} AS kind, i, m, v, sum(length(gap) + length(m)) OVER (PARTITION BY row ORDER BY i) - length(m) AS s
  FROM (SELECT row, doc_id, source, generate_subscripts(ms, 1) AS i, unnest(ms) AS m, unnest(vs) AS v, unnest(gaps[1:len(ms)]) AS gap
        FROM (SELECT row, doc_id, source, regexp_extract_all(text, '{pattern}') AS ms, regexp_extract_all(text, '{pattern}', {group}) AS vs, string_split_regex(text, '{pattern}') AS gaps FROM docs))
"""


def _oracle() -> str:
    kinds = ((ASSIGN, 2), (ACCESS, 0), (HEX, 0), (CANDIDATE, 0))
    found = " UNION ALL ".join(_ORACLE_KIND.format(kind=k, pattern=p.replace("'", "''"), group=g) for k, (p, g) in enumerate(kinds))
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents),
found AS ({found}),
kept AS (
  SELECT * FROM found WHERE (kind = 0 AND length(v) >= {LEAST_ASSIGN}) OR (kind = 1 AND length(m) >= {LEAST_ACCESS}) OR (kind = 2 AND length(m) >= {LEAST_HEX})
     OR (kind = 3 AND regexp_matches(m, '[A-Za-z]') AND regexp_matches(m, '[0-9]') AND NOT regexp_matches(m, '^[0-9a-f]+$'))),
live AS (SELECT v FROM kept WHERE kind = 3 GROUP BY v HAVING count(DISTINCT coalesce(source, chr(1))) <= {MOST_OWNERS}),
shown AS (
  SELECT row, kind, s, s + length(m) AS e, {list(KINDS)}[kind + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(s + length(m) AS BIGINT) AS told
  FROM kept WHERE kind < 3 OR v IN (SELECT v FROM live)),
grouped AS (
  SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         coalesce(string_agg(told, ',' ORDER BY s, kind) FILTER (kind < 3), '') AS base, string_agg(told, ',' ORDER BY s, kind) AS spans
  FROM shown GROUP BY row)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN grouped g ON d.row = g.row
"""


ORACLE = _oracle()
