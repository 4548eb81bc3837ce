"""Operator 6: quality rules by a hashed n-gram log-likelihood ratio. DataFrame functions only.

Two multinomials over hashed n-grams are compared: trusted target documents and the raw corpus.
A document's ratio, divided by its number of n-grams, is held against a fixed threshold. Weights
are whole numbers, so sums and verdicts are the same in every run and order of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.session import fresh

WORD = r"[^\x20\x09-\x0D]+"
#: Runs of letters, digits and underscores, or runs of other visible characters.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\x20\x09-\x0D]+"
#: Buckets for single tokens and as many for pairs.
BUCKETS = 8_192
#: Pairs are hashed as first * PAIR + second.
PAIR = 1_000_003
#: At most so many trusted documents fit the target model (those with the lowest hashes of doc_id).
TRUSTED_ROWS = 20_000
#: Added to each bucket's count.
SMOOTH = 1.0
#: Weights are in millionths of a nat.
UNIT = 1_000_000
#: Documents with a mean ratio (nats for each n-gram) below this are rejected.
THRESHOLD = -0.2
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
WINDOW = 5

_SYMBOLS = "#*$%&|<>"


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once and calls it ``name`` in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def base_features(text: str = "text") -> list[Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; null: none."""
    t = f"coalesce({text}, '')"
    word = WORD.replace("\\", "\\\\")
    lines = f"filter(split({t}, '\\n', -1), l -> l rlike '{word[:-1]}')"
    words = f"regexp_extract_all({t}, '{word}', 0)"
    grams = "transform(slice(h, 1, size(h) - 4), (x, i) -> xxhash64(x, h[i + 1], h[i + 2], h[i + 3], h[i + 4]))"
    covered = "aggregate(transform(p, (x, i) -> IF(i + 1 < size(p), least(5, p[i + 1] - x), 5)), 0, (a, x) -> a + x)"
    starts = "array_sort(transform(filter(o, (x, i) -> x.g <=> get(o, i - 1).g OR x.g <=> get(o, i + 1).g), x -> x.i))"
    several = _let("sort_array(transform(g, (x, i) -> struct(x AS g, i AS i)))", "o", _let(starts, "p", covered))
    repeats = _let(grams, "g", f"IF(size(array_distinct(g)) = size(g), 0, {several})")
    inside = _let("transform(w, x -> xxhash64(x))", "h", f"IF(size(h) < 5, 0, {repeats})")
    both = _let(words, "w", f"struct(size(w) AS n, {inside} AS r, aggregate(w, 0L, (a, x) -> a + length(x)) AS c)")
    return [
        F.expr(both).alias("_words"),
        F.expr(f"cast(regexp_count({t}, '[{_SYMBOLS}]') AS bigint)").alias("n_symbols"),
        F.expr(_let(lines, "l", "cast(size(l) - size(array_distinct(l)) AS bigint)")).alias("n_dup_lines"),
    ]


def gram_buckets(text: str = "text") -> Column:
    """Array of hashed n-grams: tokens below ``BUCKETS``, pairs of neighbours from there on."""
    token = TOKEN.replace("\\", "\\\\")
    found = f"transform(regexp_extract_all(coalesce({text}, ''), '{token}', 0), w -> crc32(cast(w AS binary)))"
    single = f"transform(c, x -> cast(x % {BUCKETS} AS int))"
    pair = f"transform(slice(c, 2, greatest(size(c) - 1, 0)), (x, i) -> cast((c[i] * {PAIR} + x) % {BUCKETS} + {BUCKETS} AS int))"
    return F.expr(_let(found, "c", f"concat({single}, {pair})"))


def gram_counts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(bucket, r, t) over all texts and over the chosen ones, in one pass; at most ``2 * BUCKETS`` rows, combined map-side."""
    told = docs.join(chosen.select(F.col("doc_id"), F.lit(1).alias("mark")), "doc_id", "left")
    return told.select("mark", F.explode(gram_buckets()).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("r"), F.count("mark").alias("t"))


def trusted(labels: DataFrame) -> DataFrame:
    """doc_ids of at most ``TRUSTED_ROWS`` rows labelled good and not toxic."""
    good = labels.where("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return good.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(TRUSTED_ROWS)


def weights(docs: DataFrame, labels: DataFrame) -> list[int] | None:
    """Weight of each bucket in millionths of a nat, or None without trusted text.

    Counts are over whole texts of all rows; the driver sees one number for each bucket.
    """
    chosen = F.broadcast(trusted(labels))  # at most TRUSTED_ROWS ids
    counts = {row.bucket: (row.t, row.r) for row in gram_counts(docs, chosen).collect()}
    t_all, r_all = sum(t for t, _ in counts.values()), sum(r for _, r in counts.values())
    if not t_all:
        return None
    size = 2 * BUCKETS
    shift = math.log((t_all + SMOOTH * size) / (r_all + SMOOTH * size))
    return [round(UNIT * (math.log((t + SMOOTH) / (r + SMOOTH)) - shift)) for t, r in (counts.get(k, (0, 0)) for k in range(size))]


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def _judged(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the result columns, and the names under which they stand."""
    values = weights(docs.select("doc_id", "text"), labels)
    name = dict(zip((*RESULTS, "words", "grams"), fresh(docs.columns, *RESULTS, "words", "grams")))
    c = lambda n: F.col(name[n])
    w = F.col(name["words"])
    t = docs.select("*", *[f.alias(name[n]) for f, n in zip(base_features(), ("words", "n_symbols", "n_dup_lines"))])
    t = t.withColumns({name["n_words"]: w["n"].cast("long"), name["word_chars"]: w["c"], name["n_repeat_words"]: w["r"].cast("long")}).drop(name["words"])
    failed = (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words"))
    t = t.withColumn(name["base_failed"], failed)
    if values is None:
        return t.withColumn(name["score"], F.lit(None).cast("double")).withColumn(name["kept"], ~c("base_failed")), name
    table = F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")  # a constant of bounded size
    total = F.aggregate(name["grams"], F.lit(0).cast("long"), lambda a, b: a + F.get(table, b))
    t = t.withColumn(name["grams"], gram_buckets())
    t = t.withColumn(name["score"], F.when(F.size(name["grams"]) > 0, total / F.size(name["grams"]) / UNIT)).drop(name["grams"])
    return t.withColumn(name["kept"], ~c("base_failed") & F.coalesce(c("score") >= THRESHOLD, F.lit(True))), name


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    ``score`` is the mean ratio in nats (null without n-grams or without trusted documents, and
    then it rejects nothing). Null texts count as empty and fail the base rule. Rows are judged
    each for itself and whole, however long: repeated rows, null ids and ties are kept apart; an
    empty table stays empty. Result columns replace columns of the same names.
    """
    t, name = _judged(docs, labels)
    return t.drop(*RESULTS).withColumnsRenamed({name[n]: n for n in RESULTS})


def drop_failing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``; edge cases as in :func:`assess`."""
    t, name = _judged(docs, labels)
    return t.where(F.col(name["kept"])).select(*docs.columns)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge all documents; trusted are those labelled good and not toxic."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    t = assess(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return t.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 6).alias("score"))


ORACLE = rf"""
WITH RECURSIVE steps(i, k, c) AS (
  SELECT range, 0, range FROM range(256) UNION ALL SELECT i, k + 1, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS (SELECT doc_id, regexp_extract_all(text, '{TOKEN}') AS w FROM docs),
flat AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM found),
hexed AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM flat)),
hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda j: CAST('0x' || substr(h, 2 * j + 1, 2) AS BIGINT))),
                            lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS c FROM hexed, crc),
coded AS (SELECT doc_id, p, c, lag(c) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM flat JOIN hashed USING (w)),
grams AS (
  SELECT doc_id, c % {BUCKETS} AS bucket FROM coded UNION ALL
  SELECT doc_id, (before * {PAIR} + c) % {BUCKETS} + {BUCKETS} FROM coded WHERE before IS NOT NULL),
chosen AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND toxic = 0 ORDER BY md5(CAST(doc_id AS VARCHAR)) LIMIT {TRUSTED_ROWS}),
counts AS (SELECT bucket, count(*) AS r, count(*) FILTER (doc_id IN (SELECT doc_id FROM chosen)) AS t FROM grams GROUP BY bucket),
totals AS (SELECT ln((sum(t) + {SMOOTH * 2 * BUCKETS}) / (sum(r) + {SMOOTH * 2 * BUCKETS})) AS shift FROM counts),
weights AS (SELECT bucket, CAST(round({UNIT} * (ln((t + {SMOOTH}) / (r + {SMOOTH})) - shift)) AS BIGINT) AS weight FROM counts, totals),
scores AS (SELECT doc_id, sum(weight) / count(*) / {UNIT} AS score FROM grams JOIN weights USING (bucket) GROUP BY doc_id),
words AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD}') AS w FROM docs),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS p, w FROM words WHERE len(w) >= 5),
repeated AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p:p + 4]) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM repeated, (VALUES (0), (1), (2), (3), (4)) AS v(k) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM docs) WHERE regexp_matches(l, '{WORD[:-1]}') GROUP BY doc_id),
base AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '{_SYMBOLS}', '')) AS BIGINT) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM words d LEFT JOIN lines l ON d.doc_id = l.doc_id LEFT JOIN covered c ON d.doc_id = c.doc_id),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base)
SELECT b.*, NOT base_failed AND coalesce(s.score >= {THRESHOLD}, true) AS kept, round(s.score, 6) AS score FROM judged b LEFT JOIN scores s ON b.doc_id = s.doc_id
"""
