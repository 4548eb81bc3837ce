"""Operator 7: near-duplicate embeddings by cross-polytope hashing.

Unit vectors are rotated by three rounds of random signs and a fast Hadamard transform; the
largest coordinate and its sign are a hash. Pairs of such hashes make the buckets of a table,
and each vector also stands in the buckets next most likely for it (multiprobe). Members of a
bucket are compared in blocks by exact cosines in double precision. Blocks give sums of links
and the edges of a spanning forest, so a large group never becomes a table of all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.operators.graph import connected_components
from tallyloom.session import map_batches, materialize

COSINE = 0.93
TABLES = 6
#: Buckets of a table in which a vector stands.
PROBES = 4
#: Members of a bucket that are compared in one block, rows of a block that are multiplied at once, and pairs checked at once.
BLOCK, TILE, PAIRS = 2_048, 512, 1 << 16
#: Rows in groups up to this size are compared neighbour by neighbour, all groups at once.
SMALL = 32
_SEED = 71


def _signs(dims: int, table: int, half: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([_SEED, dims, table, half])).choice([-1.0, 1.0], size=(3, dims))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2)
        h *= 2
    return x.reshape(n, d) / np.sqrt(d)


def probes(unit: np.ndarray, table: int, count: int = PROBES) -> np.ndarray:
    """Buckets of one table for rows of unit vectors: (n, count), the most likely one first.

    A bucket joins the hashes of two rotations. The next best choice in either costs the square
    of the gap between the largest coordinates.
    """
    n, dims = unit.shape
    size = 1 << max(1, (dims - 1).bit_length())
    x = np.zeros((n, size))
    x[:, :dims] = unit
    choices, costs = [], []
    for half in range(2):
        y = x
        for sign in _signs(size, table, half):
            y = hadamard(y * sign)
        top = np.argpartition(-np.abs(y), min(3, size - 1), axis=1)[:, : min(3, size)]
        value = np.take_along_axis(y, top, axis=1)
        order = np.argsort(-np.abs(value), axis=1, kind="stable")
        top, value = np.take_along_axis(top, order, axis=1), np.take_along_axis(value, order, axis=1)
        choices.append(2 * top + (value < 0))
        costs.append((np.abs(value[:, :1]) - np.abs(value)) ** 2)
    width = choices[0].shape[1]
    joined = (choices[0][:, :, None] * (2 * size) + choices[1][:, None, :]).reshape(n, -1)
    cost = (costs[0][:, :, None] + costs[1][:, None, :]).reshape(n, -1)
    best = np.argsort(cost, axis=1, kind="stable")[:, : min(count, width * width)]
    return np.take_along_axis(joined, best, axis=1)


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


CLASS = "class_id long, k1 long, k2 long, label string, dims int, copies long, embedding array<{}>"


def _hashed(classes: DataFrame, kind: str) -> DataFrame:
    """Adds ``codes``: PROBES buckets of each table, table by table."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy(zero_copy_only=False)
            for size in np.unique(dims):
                part = batch.filter(pa.array(dims == size))
                x = _vectors(part.column("embedding"))
                unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                found = np.concatenate([probes(unit, t) for t in range(TABLES)], axis=1).astype(np.int32)
                lists = pa.ListArray.from_arrays((np.arange(len(x) + 1) * found.shape[1]).astype(np.int32), pa.array(found.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "codes"])

    return map_batches(classes, code, CLASS.format(kind) + ", codes array<int>")


def candidate_pairs(group: np.ndarray, unit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i < j) of pairs in the same group that may be linked, by single-precision cosines; rows sorted by group."""
    borders = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    sizes = np.diff(borders)
    small = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
    own, vectors = group[small], unit[small]
    for step in range(1, int(sizes[sizes <= SMALL].max(initial=1))):
        i = np.flatnonzero(own[step:] == own[:-step])
        near = np.einsum("ij,ij->i", vectors[i], vectors[i + step]) >= COSINE - 1e-4
        yield small[i[near]], small[i[near] + step]
    for k in np.flatnonzero(sizes > SMALL):
        first, last = borders[k], borders[k + 1]
        for row in range(first, last, TILE):
            end = min(row + TILE, last)
            i, j = np.nonzero(unit[row:end] @ unit[row:last].T >= COSINE - 1e-4)
            ahead = i < j
            yield row + i[ahead], row + j[ahead]


def linked_pairs(group: np.ndarray, side: np.ndarray, x: np.ndarray, codes: np.ndarray, table: np.ndarray, code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i, j) of linked pairs in rows sorted by group, in portions; side 2 meets all, 0 meets 1.

    A pair that shares several buckets counts only in the first table, and there in the lowest code.
    """
    norms = np.sqrt((x * x).sum(axis=1))
    unit = (x / norms[:, None]).astype(np.float32)
    width = codes.shape[1] // TABLES
    for near_i, near_j in candidate_pairs(group, unit):
        meet = (side[near_i] == 2) | (side[near_i] != side[near_j])
        near_i, near_j = near_i[meet], near_j[meet]
        for at in range(0, len(near_i), PAIRS):
            i, j = near_i[at : at + PAIRS], near_j[at : at + PAIRS]
            exact = np.einsum("ij,ij->i", x[i], x[j]) / (norms[i] * norms[j]) >= COSINE
            i, j = i[exact], j[exact]
            for t in range(TABLES):
                u, v = codes[i, t * width : (t + 1) * width], codes[j, t * width : (t + 1) * width]
                shared = (u[:, :, None] == v[:, None, :]).any(axis=2)
                lowest = np.where(shared, u, np.iinfo(np.int32).max).min(axis=1)
                keep = np.where(table[i] == t, lowest == code[i], (table[i] < t) | ~shared.any(axis=1))
                i, j = i[keep], j[keep]
            if len(i):
                yield i, j


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each id in the pairs (a, b), the smallest id that the pairs connect it with."""
    ids, back = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = back[: len(a)], back[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return ids, ids[label]
        label = new


def _compared(members: DataFrame) -> DataFrame:
    """(class_id, links, root) rows: linked copies found in some buckets, and a smaller id to join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= 16_384:
                table = pa.Table.from_batches(held).combine_chunks()
                last = table.column("key")[count - 1].as_py()
                keys = table.column("key").to_numpy()
                whole = int(np.searchsorted(keys, last))  # the last group may go on
                if whole:
                    yield from found(table.slice(0, whole))
                held = table.slice(whole).to_batches()
                count -= whole
        if count:
            yield from found(pa.Table.from_batches(held).combine_chunks())

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = table.column("key").to_numpy()
        borders = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        company = np.repeat(np.diff(borders) > 1, np.diff(borders))
        table = table.filter(pa.array(company))
        dims = table.column("dims").to_numpy()
        for size in np.unique(dims):
            part = table.filter(pa.array(dims == size)).combine_chunks()
            get = lambda name: part.column(name).to_numpy()
            x = _vectors(part.column("embedding").combine_chunks())
            codes = part.column("codes").combine_chunks().flatten().to_numpy().reshape(len(x), -1)
            ids, copies = get("class_id"), get("copies")
            links = np.zeros(len(x), dtype=np.int64)
            ends: list[tuple[np.ndarray, np.ndarray]] = []
            for i, j in linked_pairs(get("key"), get("side"), x, codes, get("tab"), get("code")):
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                ends.append(forest(ids[i], ids[j]))
            if ends:
                # the links of rows, and the edges that hold their classes together
                told = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(ids[told]), pa.array(links[told]), pa.array(ids[told])], names=["class_id", "links", "root"])
                nodes, roots = forest(*(np.concatenate(part) for part in zip(*ends)))
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.zeros(len(nodes), dtype=np.int64)), pa.array(roots)], names=["class_id", "links", "root"])

    return map_batches(members, run, "class_id long, links long, root long")


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector; columns: vec_id, embedding, label.

    Vectors with null label or id, and those that are null, empty, zero or hold null or non-finite
    components, link with nothing (n_links 0; the component is the own id). Lengths must agree.
    Equal vectors of a label form a class that is compared once and counts with all its copies.
    Repeated rows count as copies; different vectors with one id share its links and component.
    Cosines are taken in double precision from the components as they are stored. An empty table
    gives an empty table; other columns are ignored, and there are no ties.
    """
    kind = "double" if vectors.schema["embedding"].dataType.simpleString() == "array<double>" else "float"
    e = F.col("embedding").cast(f"array<{kind}>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), e.alias("embedding"))
    sound = F.expr("size(embedding) > 0 AND forall(embedding, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('infinity')) AND exists(embedding, v -> v <> 0)")
    rows = rows.withColumn("usable", F.coalesce(sound & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
    good = rows.where("usable").withColumns({"k1": F.xxhash64("label", "embedding"), "k2": F.xxhash64(F.lit("second"), "label", "embedding")})
    classes = good.groupBy("k1", "k2").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("copies"))
    first = good.join(classes, ["k1", "k2"]).where("vec_id = class_id").dropDuplicates(["k1", "k2"])
    # two classes have the same least id where an id stands by several vectors; their hashes part them
    plain = first.select("class_id", "k1", "k2", "label", F.size("embedding").alias("dims"), "copies", "embedding")
    hashed = materialize(_hashed(plain, kind), "hashed-vectors")
    spots = hashed.select("class_id", "k1", "k2", "label", "dims", F.posexplode("codes").alias("at", "code")).withColumn("tab", F.floor(F.col("at") / PROBES).cast("int"))
    bucket = ["label", "dims", "tab", "code"]
    crowds = spots.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    seats = spots.join(crowds, bucket).withColumn("block", F.pmod(F.xxhash64("k2", F.lit(5)), F.col("blocks")).cast("int"))
    # a block meets itself and every other block once
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    seats = seats.withColumn("other", other).withColumn("side", F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1))
    key = F.xxhash64(*bucket, F.least("block", "other"), F.greatest("block", "other"))
    seats = seats.select("k1", "k2", "tab", "code", "side", key.alias("key"))
    members = seats.join(hashed.select("class_id", "k1", "k2", "dims", "copies", "embedding", "codes"), ["k1", "k2"])
    members = members.select("key", "class_id", "dims", "copies", "embedding", "codes", "tab", "code", "side")
    found = materialize(_compared(members.repartition("key").sortWithinPartitions("key", "side")), "vector-links")
    components = connected_components(found.where("links = 0").select(F.col("class_id").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    of = good.select("vec_id", "k1", "k2").join(classes, ["k1", "k2"])
    of = of.join(links, "class_id", "left").join(components.withColumnRenamed("node", "class_id"), "class_id", "left")
    linked = of.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "class_id").alias("component_id"))
    rest = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all embeddings."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pairs AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.93),
sides AS (SELECT u, w FROM pairs UNION ALL SELECT w, u FROM pairs),
reach(node, root) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT s.w, r.root FROM reach r JOIN sides s ON r.node = s.u AND r.root < s.w),
low AS (SELECT node, min(root) AS c FROM reach GROUP BY node),
many AS (SELECT u, count(*) AS n FROM sides GROUP BY u)
SELECT v.vec_id, coalesce(n, 0) AS n_links, c AS component_id, v.vec_id = c AS kept
FROM v JOIN low ON node = v.vec_id LEFT JOIN many ON many.u = v.vec_id
"""
