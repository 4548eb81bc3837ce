"""Operator 8: near-duplicate documents by SetSketch registers.

Texts with equal shingle sets form a class, and one representative goes on. Its SetSketch holds
for each register the exponentially spaced, truncated minimum of the shingles' exponential
hashes. Runs of registers are banded; documents that share a band are candidates. A candidate
pair's similarity is estimated by likelihood from how its registers compare, and pairs that may
reach the threshold are verified on their full sets.

Pairs in a band are taken in two steps, so that a large group never becomes all its pairs: first
every member against the least member, then, after components are formed, only members of
different components, whose registers agree well enough.

Only classes are nodes of the graph, under a hash of their set; documents take the component of
their class in one last join, so a large group of copies is never gathered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.llm import shingles
from tallyloom.operators.graph import connected_components
from tallyloom.session import bounded, fresh, map_batches, materialize, release

SHINGLE = 5
REGISTERS = 512
#: Base, rate and highest value of the registers: exponent steps so fine that equality is nearly that of minima.
BASE, RATE, TOP = 1.001, 20.0, 65_534
#: Register values that make up a band, and bands, for similarities from 0.85 and from 0.8.
ROWS_85, BANDS_85 = 5, 25
ROWS_80, BANDS_80 = 4, 32
#: A pair goes to verification unless its estimate is this many standard deviations below the threshold.
MARGIN = 4.0
#: Elements reach registers without repeats, so estimates of sets of up to so many shingles scatter less than independent
#: registers would: by this factor or less (measured: 0.75 for the likelihood, 0.82 for the compact comparison).
SMALL_SET, SMALL_SCATTER = 500, 0.85
#: Tables of keys with at most so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000
SIGNED = "doc_id long, k1 long, k2 long, n_shingles long, set1 long, set2 long, bands array<long>, registers binary, bits array<long>"


def sketch(grams: np.ndarray, owner: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """SetSketch registers of ``n`` sets given as (element hash, owner) arrays: an (n, registers) array.

    Every element reaches each register once, in an order of its own and at ascending times: its
    k-th arrival lies in the k-th of ``registers`` equally likely parts of an exponential variable.
    A set needs only so many arrivals of its elements as may still be the first at some register.
    """
    least = np.full(n * registers, np.iinfo(np.uint64).max, dtype=np.uint64)
    if len(grams):
        bits, low = np.uint64(registers.bit_length() - 1), np.uint32(registers - 1)
        sizes = np.bincount(owner, minlength=n)
        # enough arrivals of each element for nearly all sets; the others go on
        upto = np.clip(np.ceil(registers * -np.expm1(-(math.log(registers) + 2.0) / np.maximum(sizes, 1))), 1, registers).astype(np.int64)
        done = np.zeros(n, dtype=np.int64)
        open_sets = np.flatnonzero(sizes > 0)
        state, who = grams, owner
        while len(open_sets):
            count = (upto - done)[who]
            ends = np.cumsum(count)
            row = np.repeat(np.arange(len(who), dtype=np.int32), count)
            k = np.arange(ends[-1]) - np.repeat(ends - count - done[who], count)
            order = shingles.mix(state ^ np.uint64(0xA0761D6478BD642F))
            key = (order[:, None] >> np.array([0, 16, 32, 48], dtype=np.uint64)).astype(np.uint32)
            small = k.astype(np.uint32)
            place = (small * (key[row, 0] | np.uint32(1)) + key[row, 1]) & low
            place ^= place >> np.uint32(4)
            place = (place * (key[row, 2] | np.uint32(1)) + key[row, 3]) & low
            wide = k.astype(np.uint64)
            time = shingles.mix(state[row] + wide * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(bits + np.uint64(1))
            time |= wide << (np.uint64(63) - bits)
            np.minimum.at(least, who[row] * registers + place, time)
            done = upto
            latest = least.reshape(n, registers)[open_sets].max(axis=1) >> (np.uint64(63) - bits)
            open_sets = open_sets[(latest.astype(np.int64) >= done[open_sets]) & (done[open_sets] < registers)]
            upto = np.minimum(2 * done, registers)
            on = np.isin(who, open_sets)
            state, who = state[on], who[on]
    with np.errstate(divide="ignore", over="ignore"):
        arrival = -np.log1p(-np.minimum(least.astype(np.float64) * 2.0**-63, 1 - 2.0**-53)) / RATE
        values = np.floor(1.0 - np.log(arrival) / math.log(BASE))
    return np.clip(values, 0, TOP + 1).reshape(n, registers).astype(np.uint16)


def pair_similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of register rows, given the set sizes.

    With u = |A|/|union of sizes| and v likewise, a register of A is the higher one with
    probability p(u - v J), that of B with p(v - u J), where p(x) = -log_b(1 - x (b - 1) / b);
    the likelihood of the counts is highest where its derivative falls through zero.
    """
    higher, lower = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - higher - lower
    u, v = na / (na + nb), nb / (na + nb)
    low, high = np.zeros(len(a)), np.minimum(u / v, v / u)
    step, log_b = (BASE - 1) / BASE, math.log(BASE)

    def slope(j: np.ndarray) -> np.ndarray:
        def part(x, dx):
            return -np.log1p(-x * step) / log_b, dx * step / (1 - x * step) / log_b

        p, dp = part(np.maximum(u - v * j, 1e-12), -v)
        q, dq = part(np.maximum(v - u * j, 1e-12), -u)
        r = np.maximum(1 - p - q, 1e-12)
        return higher * dp / p + lower * dq / q - equal * (dp + dq) / r

    for _ in range(40):
        middle = (low + high) / 2
        rising = slope(middle) > 0
        low, high = np.where(rising, middle, low), np.where(rising, high, middle)
    return low


def signatures(docs: DataFrame, rows: int, bands: int) -> DataFrame:
    """(doc_id, k1, k2, n_shingles, set1, set2, bands, registers, bits) of every document; null and empty texts have size 0."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, k1, k2 = batch.column(0), batch.column(1), batch.column(2)
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass").lower() for t in batch.column(3)]
            for first, last in shingles.chunks(texts):
                yield _signed(texts[first:last], ids.slice(first, last - first), k1.slice(first, last - first), k2.slice(first, last - first), rows, bands)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "k1", "k2", F.col("text").cast("string").alias("text"))
    return map_batches(plain, sign, SIGNED)


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of lower-cased texts: (hash, text number), sorted by text and hash."""
    words, at = shingles.word_hashes(texts)
    counts = np.diff(at)
    grams = shingles.gram_hashes(words, SHINGLE)
    owner = np.repeat(np.arange(len(texts)), np.maximum(counts - SHINGLE + 1, 0))
    first = np.repeat(at[:-1] - np.concatenate(([0], np.cumsum(np.maximum(counts - SHINGLE + 1, 0))))[:-1], np.maximum(counts - SHINGLE + 1, 0))
    hashes = grams[np.arange(len(owner)) + first] if len(owner) else grams[:0]
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        whole = np.array([int(shingles.mix(np.array([np.sum(words[at[k] : at[k + 1]] * (np.arange(1, counts[k] + 1, dtype=np.uint64) * np.uint64(0x8EBC6AF09C88C6E3) | np.uint64(1)), dtype=np.uint64)], dtype=np.uint64))[0]) for k in short], dtype=np.uint64)
        hashes, owner = np.concatenate((hashes, whole)), np.concatenate((owner, short))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    if len(hashes):
        new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])))
        hashes, owner = hashes[new], owner[new]
    return hashes, owner


def _signed(texts: list[bytes], ids: pa.Array, k1: pa.Array, k2: pa.Array, rows: int, bands: int) -> pa.RecordBatch:
    n = len(texts)
    grams, owner = shingle_sets(texts)
    sizes = np.bincount(owner, minlength=n)
    registers = sketch(grams, owner, n)
    wide = registers.astype(np.uint64)
    names = [np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)]
    for k, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):  # order-free digests of the set
        np.add.at(names[k], owner, shingles.mix(grams ^ np.uint64(salt)))
    banded = np.zeros((n, bands), dtype=np.uint64)
    for band in range(bands):
        value = np.full(n, band + 1, dtype=np.uint64)
        for k in range(rows):
            value = shingles.mix(value + wide[:, band * rows + k] * np.uint64(0xD6E8FEB86659FD93))
        banded[:, band] = value
    # two low bits of a hash of each register, packed: a compact stand-in for a first comparison
    two = (shingles.mix(wide) & np.uint64(3)).astype(np.uint8)
    bits = np.packbits(np.unpackbits(two[:, :, None], axis=2)[:, :, 6:].reshape(n, -1), axis=1).view(np.int64)
    full = sizes > 0
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": ids, "k1": k1, "k2": k2, "n_shingles": pa.array(sizes.astype(np.int64)),
            "set1": pa.array(names[0].view(np.int64)), "set2": pa.array(names[1].view(np.int64)),
            "bands": pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(full * bands))).astype(np.int32), pa.array(banded[full].reshape(-1).view(np.int64))),
            "registers": pa.array([registers[k].tobytes() if full[k] else b"" for k in range(n)], pa.binary()),
            "bits": pa.ListArray.from_arrays((np.arange(n + 1) * bits.shape[1]).astype(np.int32), pa.array(bits.reshape(-1))),
        }
    )


def _deviation(threshold: float) -> float:
    return math.sqrt(threshold * (1 - threshold) / REGISTERS)


def _plausible(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose likelihood estimate is not far below the threshold."""
    scatter = MARGIN * _deviation(threshold)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ra, rb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for k in (4, 5))
                na, nb = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (2, 3))
                floor = threshold - np.where(np.maximum(na, nb) <= SMALL_SET, SMALL_SCATTER, 1.0) * scatter
                keep = pa.array(pair_similarity(ra, rb, na, nb) >= floor)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    side = lambda s: reps.select(F.col("node").alias(s), F.col("n_shingles").alias("n" + s), F.col("registers").alias("r" + s))
    # the first of a pair may have many partners: its registers come last, where a skewed join can be split
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "ra", "rb")
    # sizes alone bound the similarity
    near = both.where(F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - 1e-9)
    return map_batches(near, judge, "a long, b long")


def _grams(text: str = "text") -> F.Column:
    """The set of a text as an array of 64-bit hashes of its distinct shingles."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = f"regexp_extract_all(translate(coalesce({text}, ''), '{upper}', '{upper.lower()}'), '[^\\\\x20\\\\x09-\\\\x0D]+', 0)"
    runs = "array_distinct(transform(slice(w, 1, size(w) - 4), (x, i) -> xxhash64(x, w[i + 1], w[i + 2], w[i + 3], w[i + 4])))"
    whole = "IF(size(w) = 0, cast(array() AS array<bigint>), array(xxhash64(array_join(w, ' '))))"
    return F.expr(f"element_at(transform(array({words}), w -> IF(size(w) < {SHINGLE}, {whole}, {runs})), 1)")


def _sets(nodes: DataFrame, reps: DataFrame, keyed: DataFrame) -> DataFrame:
    """(node, grams) of the wanted classes: the full sets, from one text of each class."""
    wanted = materialize(nodes.distinct().join(reps.select("node", "k1", "k2"), "node"), "wanted-sets")
    # rows with these keys are equal texts
    sets = materialize(keyed.join(bounded(wanted, BROADCAST_ROWS), ["k1", "k2"]).dropDuplicates(["node"]).select("node", _grams().alias("grams")), "full-sets")
    release(wanted)
    return sets


def _similar(a: str, b: str, percent: int) -> str:
    """SQL for 100 * |intersection| >= percent * |union| of two arrays of distinct values."""
    return f"{100 + percent} * size(array_intersect({a}, {b})) >= {percent} * (size({a}) + size({b}))"


def _verified(pairs: DataFrame, reps: DataFrame, keyed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that are similar enough on the full sets."""
    sets = _sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), reps, keyed)
    side = lambda s: sets.select(F.col("node").alias(s), F.col("grams").alias("g" + s))
    # the first of a pair may have many partners: its set comes last, where a skewed join can be split
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    links = materialize(both.where(_similar("ga", "gb", percent)).select("a", "b"), "links")
    release(sets)
    return links


def _signed_classes(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(keyed texts, signatures, one row for each class under its node)."""
    rows, bands = (ROWS_85, BANDS_85) if percent >= 85 else (ROWS_80, BANDS_80)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = keyed.select("*", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit("second"), "doc_id", "text").alias("k2"))
    node = F.when(F.col("n_shingles") > 0, F.xxhash64("set1", "set2", "n_shingles"))
    signed = materialize(signatures(keyed, rows, bands).withColumn("node", node), "signatures")
    # combined on the map side first: the copies of a class leave a task as one row
    shared = F.struct("k1", "k2", "n_shingles", "registers", "bits", "bands")
    reps = signed.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least_id"), F.min_by(shared, F.struct("k1", "k2")).alias("x"))
    reps = materialize(reps.select("node", "least_id", "x.*"), "representatives")
    slim = materialize(signed.select("k1", "k2", "doc_id", "n_shingles", "node"), "signed-documents")
    release(signed)
    return keyed, slim, reps


def _linked(reps: DataFrame, keyed: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) that hold the linked classes together, and the classes without their registers; releases ``reps``."""
    threshold = percent / 100
    slim = reps.select("node", F.posexplode("bands").alias("band", "value"))
    least = slim.groupBy("band", "value").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1")
    shared = materialize(slim.join(least.drop("n"), ["band", "value"]), "shared-bands")  # members of bands with company
    star = shared.where("node <> a").select("a", F.col("node").alias("b")).distinct()
    likely = materialize(_plausible(star, reps, threshold), "plausible")
    links = _verified(likely, reps, keyed, percent)
    labels = materialize(connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "star-components")
    release(likely, links)
    light = materialize(reps.select("node", "k1", "k2", "n_shingles", "bits", "bands", "least_id"), "light-representatives")
    release(reps)
    added = _crossing(shared, light, keyed, labels, percent)
    release(shared)
    edges = labels.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(added.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return edges, light


def _grouped(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Signatures, and (node, part, component_id) of the classes that have a company or a component of several ids."""
    keyed, signed, reps = _signed_classes(docs, percent)
    edges, reps = _linked(reps, keyed, percent)
    # an id that stands by several texts connects their classes
    homes = signed.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("v")).where("u <> v")
    split = signed.where("node IS NOT NULL").join(homes.select("doc_id", "u"), "doc_id").select("u", F.col("node").alias("v"))
    labels = connected_components(edges.unionByName(split))
    ids = reps.select("node", "least_id").join(labels, "node")
    least = ids.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = ids.join(least, "component").select("node", F.col("component").alias("part"), "component_id")
    alone = reps.select("node", "least_id").join(labels.select("node"), "node", "left_anti")
    return signed, named.unionByName(alone.select("node", F.col("node").alias("part"), F.col("least_id").alias("component_id")))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(k1, k2, doc_id, n_shingles, component_id, kept), one row per document.

    ``docs`` needs doc_id and text; other columns are ignored. Null and empty texts have no
    shingles and link with nothing. Texts without doc_id take part in links like others, but their
    ids name no component: a component without any id is null, and its rows are kept. Rows that
    share a doc_id share a component, also where their texts differ. Very long texts go through in
    one piece; the set of one text must fit in a worker. Components are named by their smallest
    doc_id, so there are no ties. An empty table gives an empty table.
    """
    signed, parts = _grouped(docs, percent)
    parts = materialize(parts, "document-groups")
    out = signed.select("k1", "k2", "doc_id", "n_shingles", "node").join(parts, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("k1", "k2", "doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, own.isNull()).alias("kept"))


def _crossing(shared: DataFrame, reps: DataFrame, keyed: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of one band that are in different components, each once.

    Only bands with more than one component matter. The whole test stands inside the join: a
    compact comparison of the registers first, then the full sets. So only links become rows, and
    a pair that shares several bands is one only in the first; skewed bands are split by adaptive
    execution.
    """
    threshold = percent / 100
    told = shared.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = told.groupBy("band", "value").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band", "value")
    seats = materialize(told.drop("a").join(mixed, ["band", "value"]), "mixed-bands")
    sets = _sets(seats.select("node"), reps, keyed)
    rows = seats.join(reps.select("node", "n_shingles", "bits", "bands"), "node").join(sets, "node")
    rows = materialize(rows.select("band", "value", "node", "component", "n_shingles", "bits", "bands", "grams"), "mixed-members")
    release(seats, sets)
    words = 2 * REGISTERS // 64
    differ = " + ".join(f"bit_count(((x.bits[{k}] ^ y.bits[{k}]) | shiftrightunsigned(x.bits[{k}] ^ y.bits[{k}], 1)) & 6148914691236517205L)" for k in range(words))
    # two bits of different values agree by chance one time in four
    agree = threshold + (1 - threshold) / 4
    scatter = MARGIN * math.sqrt(REGISTERS * agree * (1 - agree))
    most = f"IF(greatest(x.n_shingles, y.n_shingles) <= {SMALL_SET}, {int(REGISTERS * (1 - agree) + SMALL_SCATTER * scatter)}, {int(REGISTERS * (1 - agree) + scatter)})"
    first = "x.band = 0 OR NOT exists(sequence(1, x.band), k -> x.bands[k - 1] = y.bands[k - 1])"
    cheap = f"x.component <> y.component AND least(x.n_shingles, y.n_shingles) >= {threshold} * greatest(x.n_shingles, y.n_shingles) - 1e-9D AND {differ} <= {most} AND ({first})"
    condition = f"x.band = y.band AND x.value = y.value AND x.node < y.node AND CASE WHEN {cheap} THEN {_similar('x.grams', 'y.grams', percent)} ELSE false END"
    links = materialize(rows.alias("x").join(rows.alias("y"), F.expr(condition)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")), "crossing-links")
    release(rows)
    return links


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near copies: the one with the smallest doc_id.

    Rows without words are no copies and all stay. Of several rows with the smallest doc_id, or of
    a group without any id, the one with the least hash of id and text stays; where these are
    repeated too, one with the least hash of all columns.
    """
    signed, parts = _grouped(docs, percent)
    rows = signed.where("node IS NOT NULL").groupBy("node", "k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    rows = materialize(rows.join(parts.select("node", "part"), "node").select("part", "k1", "k2", "doc_id", "n"), "group-rows")
    best = rows.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("x")).select("x.k1", "x.k2")
    best = materialize(best, "group-heads")
    gone = bounded(materialize(rows.select("k1", "k2").join(best, ["k1", "k2"], "left_anti"), "dropped"), BROADCAST_ROWS)
    twice = materialize(rows.where("n > 1").select("k1", "k2").join(best, ["k1", "k2"], "left_semi"), "repeated-rows")
    names = fresh(docs.columns, "k1", "k2", "h")
    keys = [F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias(names[0]), F.xxhash64(F.lit("second"), F.col("doc_id").cast("long"), F.col("text").cast("string")).alias(names[1])]
    on = lambda t: t.withColumnsRenamed({"k1": names[0], "k2": names[1]})
    left = docs.select("*", *keys).join(on(gone), names[:2], "left_anti")
    if twice.isEmpty():
        return left.select(*docs.columns)
    several = left.join(on(twice), names[:2], "left_semi").withColumn(names[2], F.xxhash64(F.to_json(F.struct(*docs.columns))))
    one = several.groupBy(*names[:2]).agg(F.min_by(F.struct(*docs.columns), names[2]).alias("x")).select("x.*")
    return left.join(on(twice), names[:2], "left_anti").select(*docs.columns).unionByName(one)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all documents at a similarity of 0.85."""
    t = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return t.select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
sides AS (SELECT u, v FROM pairs UNION ALL SELECT v, u FROM pairs),
reach(node, root) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT b.v, r.root FROM reach r JOIN sides b ON r.node = b.u AND r.root < b.v),
low AS (SELECT node, min(root) AS c FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id, s.doc_id = c AS kept FROM sets s JOIN low ON node = s.doc_id
"""
