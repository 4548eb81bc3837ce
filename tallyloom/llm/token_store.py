"""Operator 5: token ids in a compressed binary table (byte planes, zstandard, chunk index).

Format: a Parquet table whose rows are chunks of whole documents in ascending doc_id order.
A chunk has (shard, chunk, start, n_ids, doc_ids, lengths, planes): ``start`` counts the ids
before it in its shard, ``doc_ids`` and ``lengths`` are its index, and ``planes`` holds for each
fixed block of ids its byte planes, each compressed with zstandard. The last block of a chunk
may be short. Rows go through Spark's committer, so lost executors leave no half-written file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyloom.llm import tokens
from tallyloom.session import map_batches, scratch_path

#: Ids in a block whose planes are transposed together.
BLOCK_IDS = 16_384
#: A chunk ends with the document that reaches this many ids.
CHUNK_IDS = 131_072
LEVEL = 1
SCHEMA = "shard int, chunk int, start long, n_ids long, doc_ids array<long>, lengths array<long>, planes binary"
INDEX_SCHEMA = "doc_id long, shard int, start long, n_tokens long, ids_crc32 long"


def pack_planes(ids: np.ndarray, level: int = LEVEL, block: int = BLOCK_IDS) -> bytes:
    """Byte planes of each block, each one compressed; planes of zeros above the highest id are left out."""
    import zstandard

    press = zstandard.ZstdCompressor(level=level)
    out = []
    for at in range(0, len(ids), block):
        part = np.ascontiguousarray(ids[at : at + block], dtype="<u4")
        planes = part.view(np.uint8).reshape(-1, 4).T
        used = max(1, (int(part.max()).bit_length() + 7) // 8)
        packed = [press.compress(planes[k].tobytes()) for k in range(used)]
        out.append(struct.pack("<IB", len(part), used) + struct.pack(f"<{used}I", *map(len, packed)) + b"".join(packed))
    return b"".join(out)


def unpack_planes(data: bytes) -> np.ndarray:
    """Inverse of :func:`pack_planes`."""
    import zstandard

    press, at, out = zstandard.ZstdDecompressor(), 0, []
    while at < len(data):
        n, used = struct.unpack_from("<IB", data, at)
        sizes = struct.unpack_from(f"<{used}I", data, at + 5)
        at += 5 + 4 * used
        planes = np.zeros((n, 4), dtype=np.uint8)
        for k, size in enumerate(sizes):
            planes[:, k] = np.frombuffer(press.decompress(data[at : at + size], max_output_size=n), dtype=np.uint8)
            at += size
        out.append(planes.reshape(-1).view("<u4"))
    return np.concatenate(out) if out else np.zeros(0, dtype="<u4")


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Encodes every whole text (null: empty), appends the end id, and writes the table at ``path``.

    ``docs`` needs doc_id and text; other columns are ignored. Documents are dealt to shards by
    ranges of doc_id, nulls first; rows with the same doc_id stay side by side in any order.
    """
    spec = tokenizer or tokens.default_path()
    end = np.array([tokens.END_ID], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, chunk, start = TaskContext.get().partitionId(), 0, 0
        tool, ids, lengths, parts, total = tokens.encoder(spec), [], [], [], 0

        def row() -> pa.RecordBatch:
            packed = pack_planes(np.frombuffer(b"".join(parts), dtype="<u4"))
            return pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "chunk": pa.array([chunk], pa.int32()), "start": pa.array([start], pa.int64()), "n_ids": pa.array([total], pa.int64()), "doc_ids": pa.array([ids], pa.list_(pa.int64())), "lengths": pa.array([lengths], pa.list_(pa.int64())), "planes": pa.array([packed], pa.binary())}
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = tool.encode(text) + end
                ids.append(doc_id)
                lengths.append(len(data) // 4)
                parts.append(data)
                total += lengths[-1]
                if total >= CHUNK_IDS:
                    yield row()
                    chunk, start = chunk + 1, start + total
                    ids, lengths, parts, total = [], [], [], 0
        if ids:
            yield row()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    map_batches(ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id"), encode, SCHEMA).write.parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the stored chunks: place, length and checksum of its decoded ids."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = unpack_planes(row["planes"]).tobytes()
                ends = np.cumsum(np.array(row["lengths"], dtype=np.int64))
                begins = ends - np.array(row["lengths"], dtype=np.int64)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array(row["doc_ids"], pa.int64()), "shard": pa.array([row["shard"]] * len(ends), pa.int32()), "start": pa.array(begins + row["start"], pa.int64()), "n_tokens": pa.array(row["lengths"], pa.int64()), "ids_crc32": pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())], pa.int64())}
                )

    chunks = spark.read.schema(SCHEMA).parquet(path)
    inside = map_batches(chunks, decode, INDEX_SCHEMA)
    totals = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # one row for each shard: the only total order needed is over these
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return inside.join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents, store them, and report each one from the stored table."""
    path = scratch_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_index(spark, path)
