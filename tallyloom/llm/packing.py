"""Operator 4: best-fit packing by length patterns and non-negative least squares.

The lengths of all pieces form a histogram with as many bins as a sequence has tokens; this
bounded table is all that the driver sees. Patterns of two to four lengths that nearly fill a
sequence are enumerated, their repeat counts fitted to the histogram by non-negative least
squares and rounded down, and what remains is packed best-fit decreasing on counts. Every piece
then looks up its sequence by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyloom.llm import tokens
from tallyloom.session import map_batches, materialize

CAPACITY = 1024
#: Pieces that share a rank group, about; the groups of a length are numbered one after another.
RANK_GROUP = 20_000
LEAST_GROUPS = 64
#: Shares of the fitted counts that are tried.
SHARES = (1.0, 0.75, 0.5, 0.25)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Token pieces of every document: whole, or cut in full pieces with a shorter first one."""
    spec = tokenizer or tokens.default_path()
    end = np.array([tokens.END_ID], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = tokens.encoder(spec)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = tool.encode(text) + end
                n, at, k = len(data) // 4, 0, 0
                while at < n:
                    size = (n - at) % capacity or capacity
                    out.append((doc_id, k, at, size, zlib.crc32(data[4 * at : 4 * (at + size)])))
                    at, k = at + size, k + 1
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_pydict(
                {"doc_id": pa.array(cols[0], pa.int64()), "piece": pa.array(cols[1], pa.int32()), "start": pa.array(cols[2], pa.int64()), "length": pa.array(cols[3], pa.int64()), "ids_crc32": pa.array(cols[4], pa.int64())}
            )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(plain, cut, PIECES)


def patterns(lengths: np.ndarray, capacity: int, per_length: int = 12) -> np.ndarray:
    """Rows of up to four lengths (0: none) that fill a sequence as well as the given lengths allow."""
    at_most = np.zeros(capacity + 1, dtype=np.int64)  # the largest given length up to each bound
    at_most[lengths] = lengths
    at_most = np.maximum.accumulate(at_most)
    spread = lengths[np.unique(np.linspace(0, len(lengths) - 1, per_length).astype(int))]
    found = []
    a = lengths
    found.append(np.stack([a, at_most[capacity - a], 0 * a, 0 * a], axis=1))
    a, b = (x.ravel() for x in np.meshgrid(lengths, spread, indexing="ij"))
    a, b = a[a + b < capacity], b[a + b < capacity]
    found.append(np.stack([a, b, at_most[capacity - a - b], 0 * a], axis=1))
    thin = spread[:: max(1, len(spread) // 5)]
    a, b, c = (x.ravel() for x in np.meshgrid(lengths, thin, thin, indexing="ij"))
    fits = (a + b + c < capacity) & (b >= c)
    a, b, c = a[fits], b[fits], c[fits]
    found.append(np.stack([a, b, c, at_most[capacity - a - b - c]], axis=1))
    rows = np.unique(np.sort(np.concatenate(found), axis=1)[:, ::-1], axis=0)
    return rows[rows.sum(axis=1) >= capacity - max(1, capacity // 64)]


def fit_counts(rows: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares fit of repeat counts to the histogram, by accelerated projected gradients."""
    if not len(rows):
        return np.zeros(0)
    used = (rows > 0).astype(float)
    bins = len(histogram)
    weight = 1 / np.sqrt(np.maximum(histogram, 1.0))  # relative errors count
    back = lambda r: ((r * weight)[rows] * used).sum(axis=1)
    ahead = lambda x: weight * np.bincount(rows.ravel(), (used * x[:, None]).ravel(), bins)
    probe = np.ones(len(rows))
    for _ in range(20):
        probe = back(ahead(probe))
        probe /= np.linalg.norm(probe) or 1
    step = 1 / (np.linalg.norm(back(ahead(probe))) * 1.05)
    goal = weight * histogram
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(ahead(y) - goal))
        t, old_t = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        x, y = new, new + (old_t - 1) / t * (new - x)
    return x


def best_fit(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: (lengths of a sequence, how many such sequences)."""
    free: list[list[list]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        left = int(histogram[length])
        while left:
            room = next((r for r in range(length, capacity + 1) if free[r]), None)
            if room is None:
                each = capacity // length
                if left >= each:
                    free[capacity - each * length].append([(length,) * each, left // each])
                if left % each:
                    free[capacity - left % each * length].append([(length,) * (left % each), 1])
                break
            lengths, n = free[room].pop()
            take = min(n, left)
            if n > take:
                free[room].append([lengths, n - take])
            free[room - length].append([(*lengths, length), take])
            left -= take
    return [(lengths, n) for groups in free for lengths, n in groups]


def _with_patterns(left: np.ndarray, rows: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns as often as counts and histogram allow, then best-fit decreasing on what remains."""
    left, out = left.copy(), []
    for k in np.argsort(-rows.sum(axis=1), kind="stable"):
        row = [int(v) for v in rows[k] if v]
        n = min([int(counts[k]), *(int(left[v]) // row.count(v) for v in set(row))])
        if n > 0:
            out.append((tuple(row), n))
            for v in row:
                left[v] -= n
    return out + best_fit(left, capacity)


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with repeat counts that hold every piece of the histogram exactly once.

    The fitted counts are rounded down. As a fit of the histogram is none of the number of
    sequences, they are also scaled by ``SHARES``, and the share with the fewest sequences is
    taken; of equal ones the largest.
    """
    left = histogram.astype(np.int64).copy()
    out = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    lengths = np.flatnonzero(left)
    if not len(lengths):
        return out
    rows = patterns(lengths, capacity)
    fitted = fit_counts(rows, left.astype(float))
    tried = [_with_patterns(left, rows, np.floor(share * fitted + 1e-9).astype(np.int64), capacity) for share in SHARES]
    return out + min(tried, key=lambda groups: sum(n for _, n in groups))


def slots(groups: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first ranks (ascending), the sequence of each first rank, and the offset."""
    table: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    base = 0
    for lengths, n in groups:
        offset = 0
        for length in lengths:
            table.setdefault(length, []).append((ranks.get(length, 0), base, offset))
            ranks[length] = ranks.get(length, 0) + n
            offset += length
        base += n
    return {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v)) for k, v in table.items()}


def ranked(table: DataFrame, n: int) -> DataFrame:
    """Adds ``rank``: a number from 0 without gaps among the pieces of the same length.

    Each length is dealt by a hash to groups of bounded size; group sizes are summed first.
    """
    groups = max(LEAST_GROUPS, -(-n // RANK_GROUP))
    dealt = table.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    sizes = dealt.groupBy("length", "g").agg(F.count("*").alias("n"))
    before = sizes.select("length", "g", (F.sum("n").over(Window.partitionBy("length").orderBy("g")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "g").orderBy("doc_id", "piece", "ids_crc32"))
    return dealt.withColumn("inside", inside).join(before, ["length", "g"]).withColumn("rank", F.col("before") + F.col("inside") - 1)


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """One row for each piece with its place; columns of ``docs`` other than doc_id and text are ignored.

    Null and empty texts hold the end id alone. Null doc_ids and repeated rows are packed like
    others, one place each. An empty table gives an empty table.
    """
    stored = materialize(pieces(docs, capacity, tokenizer), "pieces")
    counted = stored.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most `capacity` rows
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for row in counted:
        histogram[row.length] = row.n
    lookup = slots(plan(histogram, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for value in np.unique(length):
                here = length == value
                first, base, at = lookup[int(value)]
                k = np.searchsorted(first, rank[here], side="right") - 1
                sequence[here] = base[k] + rank[here] - first[k]
                offset[here] = at[k]
            keep = [batch.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return map_batches(ranked(stored, int(histogram.sum())).drop("g", "inside", "before"), place, PLACED)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
