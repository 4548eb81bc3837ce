"""Operator 1: passages that repeat across documents, by sparse suffix arrays.

Of all suffixes (word positions) those at minimisers are retained: the least hash of a run of
words inside each window of the shortest passage. Two equal windows select the same place, so
every repeated passage has suffixes in common. Suffixes are sorted by their leading run;
neighbours with equal runs are matched, and the match is extended left and right over all the
windows that the suffix stands for: at once where the whole stretch is equal, and window by
window at the ends of passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyloom.llm import shingles
from tallyloom.session import fresh, map_batches, materialize

#: Words in the shortest passage that is found.
PASSAGE = 50
#: Words in the runs whose hashes select suffixes.
RUN = 14
_BASE = 0xC2B2AE3D27D4EB4F
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(max(n, 1 << 19), base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


class Words:
    """Word hashes of some texts, and hashes of any stretch of words in constant time."""

    def __init__(self, texts: list[bytes]):
        self.hashes, self.at = shingles.word_hashes(texts)
        self.up, self.down = _powers(len(self.hashes) + 1)
        self.sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(self.hashes * self.up[: len(self.hashes)], dtype=np.uint64)))

    def stretch(self, start: np.ndarray, length) -> np.ndarray:
        size = np.asarray(length, dtype=np.uint64)
        return shingles.mix((self.sums[start + length] - self.sums[start]) * self.down[start] + size)


def sparse_suffixes(words: Words, passage: int = PASSAGE, run: int = RUN) -> tuple[np.ndarray, ...]:
    """Retained suffixes: (text, first window, number of windows, place), windows by the words they start at."""
    n = len(words.hashes)
    empty = (np.zeros(0, dtype=np.int64),) * 4
    if n < passage:
        return empty
    places = n - run + 1
    bits = np.uint64(max(24, int(places).bit_length()))
    low = ((words.stretch(np.arange(places), run) >> bits) << bits) | np.arange(places, dtype=np.uint64)
    width, have = passage - run + 1, 1
    while have < width:  # least of `have` places, doubled until the window is covered; the first of equals
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    start = np.arange(len(low))
    owner = np.searchsorted(words.at, start, side="right") - 1
    good = start + passage <= words.at[owner + 1]
    start, owner = start[good], owner[good]
    place = (low[good] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    if not len(start):
        return empty
    new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1))))
    count = np.diff(np.concatenate((new, [len(start)])))
    return owner[new], start[new], count, place[new]


ITEM = "key long, stretch long, doc_id long, a int, n int"


def suffixes(docs: DataFrame, passage: int, run: int) -> DataFrame:
    """(key, stretch, doc_id, a, n): the leading run, all words of the windows, and the windows themselves."""

    def retain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            for first, last in shingles.chunks(texts):
                words = Words(texts[first:last])
                owner, a, n, place = sparse_suffixes(words, passage, run)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words.stretch(place, run).view(np.int64)), pa.array(words.stretch(a, n - 1 + passage).view(np.int64)), pa.array(ids[first:last][owner]), pa.array((a - words.at[owner]).astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["key", "stretch", "doc_id", "a", "n"],
                )

    plain = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(plain, retain, ITEM)


def _windows(wanted: DataFrame, passage: int) -> DataFrame:
    """Hashes of the single windows of the wanted stretches, each with its place in stretch and document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            ids, asked = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for first, last in shingles.chunks(texts):
                words = Words(texts[first:last])
                parts: list[list[np.ndarray]] = [[] for _ in range(8)]
                for k in range(first, last):
                    a, n, high, single, key, stretch = (np.array([x[c] for x in asked[k]]) for c in ("a", "n", "high", "single", "key", "stretch"))
                    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    s = np.repeat(a, n) + at
                    doc = np.full(len(s), ids[k])
                    for part, value in zip(parts, (words.stretch(words.at[k - first] + s, passage).view(np.int64), doc, np.repeat(high, n), s, np.repeat(single, n), np.repeat(key, n), np.repeat(stretch, n), at)):
                        part.append(value)
                window, doc, high, s, single, key, stretch, at = map(np.concatenate, parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(window), pa.array(doc), pa.array(high), pa.array(doc), pa.array(s.astype(np.int32)), pa.array(single.astype(bool)), pa.array(key), pa.array(stretch), pa.array(at.astype(np.int32))],
                    names=["window", "low", "high", "doc_id", "s", "single", "key", "stretch", "at"],
                )

    return map_batches(wanted, read, "window long, low long, high long, doc_id long, s int, single boolean, key long, stretch long, at int")


def repeats(docs: DataFrame, passage: int = PASSAGE, run: int = RUN) -> DataFrame:
    """Maximal stretches of words whose every window of ``passage`` words stands in at least two documents.

    Columns: doc_id, later (every window of the stretch also stands in a document with a smaller
    doc_id; stretches where this one is the first are told apart), start_word, end_word (from 0,
    end exclusive). Words are runs of other than white space and must agree in every byte.

    ``docs`` needs doc_id and text; other columns are ignored. Null ids and texts, and texts with
    fewer words, give no rows. Rows with the same doc_id are one document, and a passage repeated
    in it alone is none. An empty table gives an empty table.
    """
    items = materialize(suffixes(docs, passage, run), "suffixes")
    # neighbours in the order of leading runs: only runs of two documents or more go on
    shared = items.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key")
    items = materialize(items.join(materialize(shared, "shared-runs"), "key", "left_semi"), "matched-suffixes")
    stretches = items.groupBy("key", "stretch").agg(F.min(F.struct("doc_id", "a", "n")).alias("first"), F.max("doc_id").alias("high"))
    stretches = materialize(stretches.select("key", "stretch", "first", "high", F.col("first.doc_id").alias("low"), (F.col("first.doc_id") == F.col("high")).alias("single")), "stretches")
    # runs with several stretches are compared window by window, one example of each shared stretch standing for all
    mixed = materialize(stretches.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "mixed-runs")
    ends = items.join(stretches.where("single").select("key", "stretch"), ["key", "stretch"], "left_semi")
    ends = ends.select("doc_id", "key", "stretch", "a", "n", F.col("doc_id").alias("high"), F.lit(True).alias("single"))
    examples = stretches.where("NOT single").join(mixed, "key", "left_semi")
    examples = examples.select("first.doc_id", "key", "stretch", "first.a", "first.n", "high", F.lit(False).alias("single"))
    asked = ends.unionByName(examples).groupBy("doc_id").agg(F.collect_list(F.struct("a", "n", "high", "single", "key", "stretch")).alias("asked"))
    asked = materialize(asked, "asked-stretches")
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    windows = materialize(_windows(_fitting(texts.join(asked, "doc_id"), passage), passage), "windows")
    found = windows.groupBy("window").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least < most").select("window", "least")
    found = materialize(found, "repeated-windows")
    part = windows.where("single").join(found, "window").select("doc_id", "s", F.lit(1).alias("n"), F.col("least").alias("low"))
    # windows of a shared stretch that an earlier document has in another stretch
    earlier = windows.where("NOT single").join(found, "window").where("least < low").select("key", "stretch", "at", "least")
    earlier = materialize(earlier.distinct(), "earlier-windows")
    moved = earlier.select("key", "stretch", F.lit(True).alias("moved")).distinct()
    # equal stretches: the match reaches over all their windows. The join is written as it comes,
    # so that one that all rows share can be split over tasks.
    ready = materialize(stretches.where("NOT single").select("key", "stretch", "low").join(moved, ["key", "stretch"], "left"), "shared-stretches")
    told = materialize(items.join(ready, ["key", "stretch"]).select("key", "stretch", "doc_id", "a", "n", "low", "moved"), "matched-stretches")
    split = told.where("moved").select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at"))
    split = split.join(earlier, ["key", "stretch", "at"], "left").select("doc_id", (F.col("a") + F.col("at")).alias("s"), F.lit(1).alias("n"), F.least("low", "least").alias("low"))
    whole = told.where("moved IS NULL").select("doc_id", F.col("a").alias("s"), "n", "low")
    part = part.unionByName(split)
    marks = whole.unionByName(part).select("doc_id", (F.col("low") < F.col("doc_id")).alias("later"), "s", (F.col("s") + F.col("n") - 1 + passage).alias("e"))
    return _merged(marks.distinct(), passage)


def _fitting(rows: DataFrame, passage: int) -> DataFrame:
    """Of rows with the same doc_id and other texts, each keeps the stretches that it can hold."""
    count = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    return rows.withColumn("asked", F.filter("asked", lambda x: x["a"] + x["n"] - 1 + passage <= count)).where(F.size("asked") > 0).select("doc_id", "text", "asked")


def _merged(marks: DataFrame, passage: int) -> DataFrame:
    """Overlapping or touching runs of windows of a document joined to stretches."""
    order = Window.partitionBy("doc_id", "later").orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # windows that start right after the last ones belong to the same stretch
    fresh = F.when(F.col("s") <= before - passage + 1, 0).otherwise(1)
    t = marks.withColumn("fresh", fresh).withColumn("part", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return t.groupBy("doc_id", "later", "part").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word")).drop("part")


def cut_repeats(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` without the words of ``later`` stretches; what follows a cut word's white space stays.

    Null ids and texts, and texts without stretches, stay as they are; repeated rows are cut alike.
    Overlapping stretches are cut once; an empty table stays empty, and columns of any name come
    back unchanged.
    """
    [mark] = fresh(docs.columns, "cuts")
    lists = spans.where("later").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias(mark))
    joined = docs.join(lists, "doc_id", "left")
    at = joined.columns.index("text"), joined.columns.index(mark)
    schema = docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(at[0]).to_pylist(), batch.column(at[1]).to_pylist()):
                if text is not None and spans:
                    begins = [m.start() for m in word.finditer(text)] + [len(text)]
                    kept, last = [], 0
                    for x in spans:
                        kept.append(text[last : max(last, begins[min(x["start_word"], len(begins) - 1)])])
                        last = max(last, begins[min(x["end_word"], len(begins) - 1)])
                    text = "".join(kept) + text[last:]
                out.append(text)
            columns = [pa.array(out, pa.string()) if k == at[0] else c for k, c in enumerate(batch.columns) if k != at[1]]
            yield pa.RecordBatch.from_arrays(columns, names=[n for n in batch.schema.names if n != mark])

    from pyspark.sql.types import StructType

    order = [c for c in joined.columns if c != mark]
    return map_batches(joined, cut, StructType([schema[c] for c in order])).select(*docs.columns)


def op1_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of at least 50 words in all documents."""
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
