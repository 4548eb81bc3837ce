"""Operator 3: language identification by interpolated Kneser-Ney character models.

Runs of four characters are counted for each language over the training documents. From all counts,
interpolated Kneser-Ney probabilities are worked out as tables for every order and stored in
shards of hash arrays in ascending order. A text gets the language with the lowest cross-entropy for each
character; the score is calibrated on training documents and falls for texts that fit no model.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.llm.shingles import mix
from tallyloom.session import map_batches, materialize

ORDER = 4
DISCOUNT = 0.75
#: Values of a shard of the model, about, and shards that a worker keeps loaded.
SHARD_CELLS, HELD_SHARDS = 1 << 22, 4
#: Temperatures of the score from which the training rows choose, and the characters that count as evidence at most.
TEMPERATURES, EVIDENCE = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0), 200
#: Characters turned to codes in one go, about.
CHUNK = 1 << 19
#: Chunks whose runs are looked up together.
TOGETHER = 8
UNKNOWN = "und"
#: Entropies further above the training mean than so many deviations lower the score.
LIMIT = 4.0


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of lower-cased texts as numbers below 2**16, all else as single zeros; each text starts and ends with a zero.

    Every text is lower-cased alone. Letters beyond the basic plane share the 8,448 numbers from
    0xD800 on, which no letter of that plane has. Returns the numbers and the text of each.
    """
    # each one stands between two line ends, which are no letters
    joined = "".join(["\n" + t.lower().replace("\n", " ") + "\n" for t in texts])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ends = np.cumsum(points == 10) - 1
    owner = ends // 2
    letter = _LETTERS[np.minimum(points, len(_LETTERS) - 1)]
    high = points >= len(_LETTERS) - 1
    if high.any():
        found, back = np.unique(points[high], return_inverse=True)
        letter[high] = np.array([chr(c).isalpha() for c in found.tolist()])[back]
    out = np.where(letter, points, 0).astype(np.uint64)
    if high.any():
        out = np.where(out > 0xFFFF, 0xD800 + mix(out) % np.uint64(0x2100), out)
    begins = (points == 10) & (ends % 2 == 0)
    keep = begins | (out != 0) | np.concatenate(([False], out[:-1] != 0))
    return out[keep], owner[keep]


_LETTERS = np.array([chr(c).isalpha() for c in range(0x3000)] + [False])


def grams(numbers: np.ndarray, owner: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all runs of ``order`` numbers inside one text, and their texts."""
    n = len(numbers) - order + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(order):
        key = (key << np.uint64(16)) | (numbers[k : k + n] & np.uint64(0xFFFF))
    inside = owner[:n] == owner[order - 1 :]
    return key[inside], owner[:n][inside]


def _split(texts: list[str]):
    first, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) > CHUNK:
            yield first, k
            first, size = k, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def count_runs(training: DataFrame) -> DataFrame:
    """(lang, run, n) of (lang, text) rows: whole texts, combined inside each batch first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(1).to_pylist()
            for lang in sorted(set(langs.tolist())):
                own = [texts[k] for k in np.flatnonzero(langs == lang)]
                found: list[np.ndarray] = []
                amounts: list[np.ndarray] = []
                for first, last in _split(own):
                    key, n = np.unique(grams(*codes(own[first:last]))[0], return_counts=True)
                    found.append(key)
                    amounts.append(n)
                key, back = np.unique(np.concatenate(found), return_inverse=True)
                n = np.bincount(back, np.concatenate(amounts), len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key.view(np.int64)), pa.array(n)], names=["lang", "run", "n"])

    part = map_batches(training.select("lang", "text"), count, "lang string, run long, n long")
    return part.groupBy("lang", "run").agg(F.sum("n").alias("n"))


def smoothed(counts: DataFrame) -> tuple[DataFrame, float]:
    """(kind, run, lang, value) of interpolated Kneser-Ney, and the logarithm of an unseen character.

    ``kind`` is the order of a run with its log-probability, or minus the order of a context with
    the logarithm of the weight left for the shorter order. All runs of all languages are there.
    """
    tables = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):  # continuation counts: distinct characters before a run
        short = F.col("run").bitwiseAND(F.lit((1 << (16 * order)) - 1)).alias("run")
        tables[order] = materialize(tables[order + 1].groupBy("lang", short).agg(F.count("*").alias("n")), "language-kinds")
    unseen = 1.0 / (tables[1].select("run").distinct().count() + 1)
    parts, shorter = [], None
    for order in range(1, ORDER + 1):
        t = tables[order].withColumn("context", F.shiftrightunsigned("run", 16))
        rest = t.groupBy("lang", "context").agg(F.sum("n").alias("total"), (DISCOUNT * F.count("*") / F.sum("n")).alias("rest"))
        t = t.join(rest, ["lang", "context"])
        if shorter is None:
            t = t.withColumn("below", F.lit(unseen))
        else:
            t = t.withColumn("short", F.col("run").bitwiseAND(F.lit((1 << (16 * order - 16)) - 1))).join(shorter, ["lang", "short"])
        p = materialize(t.select("lang", "run", (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("total") + F.col("rest") * F.col("below")).alias("p")), "language-order")
        shorter = p.select("lang", F.col("run").alias("short"), F.col("p").alias("below"))
        parts.append(p.select(F.lit(order).alias("kind"), "run", "lang", F.log("p").cast("float").alias("value")))
        parts.append(rest.select(F.lit(-order).alias("kind"), F.col("context").alias("run"), "lang", F.log("rest").cast("float").alias("value")))
    return reduce(DataFrame.unionAll, parts), float(np.log(unseen))


def _arrays(rows: pa.Table, many: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By kind: hashes in ascending order, and the values of each language; NaN where it has none."""
    kind, run, lang, value = (rows.column(c).to_numpy() for c in ("kind", "run", "lang", "value"))
    out = {}
    for k in np.unique(kind).tolist():
        own = kind == k
        hashes, place = np.unique(mix(run[own].view(np.uint64)), return_inverse=True)
        values = np.full((len(hashes), many), np.nan, dtype=np.float32)
        values[place, lang[own]] = value[own]
        out[k] = hashes, values
    return out


class Model:
    """Interpolated Kneser-Ney probabilities of all languages in shards of hash arrays.

    A run is in the shard that its number names modulo their count. Few shards stay loaded; of
    many, one at a time is.
    """

    def __init__(self, langs: list[str], floor: float, shards: list):
        self.langs, self.floor, self.shards = langs, floor, shards
        self.limits = np.full(len(langs), np.inf)
        self.spread = np.ones(len(langs))
        self.temperature = TEMPERATURES[0]

    def _each(self) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
        for shared in self.shards:
            yield shared.value
            if len(self.shards) > HELD_SHARDS and getattr(shared, "_path", None):
                vars(shared).pop("_value", None)

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """Natural logarithms for each run and language."""
        many, wanted, back, got = len(self.langs), {}, {}, {}
        for order in range(1, ORDER + 1):
            short = keys & np.uint64((1 << (16 * order)) - 1)
            for kind, key in ((order, short), (-order, short >> np.uint64(16))):
                wanted[kind], back[kind] = np.unique(key, return_inverse=True)
                got[kind] = np.full((len(wanted[kind]), many), np.nan, dtype=np.float32)
        for number, shard in enumerate(self._each()):
            for kind, (hashes, values) in shard.items():
                place = np.flatnonzero(wanted[kind].view(np.int64) % len(self.shards) == number)
                hashed = mix(wanted[kind][place])
                at = np.minimum(np.searchsorted(hashes, hashed), len(hashes) - 1)
                seen = hashes[at] == hashed
                got[kind][place[seen]] = values[at[seen]]
        out = np.full((len(keys), many), self.floor, dtype=np.float32)
        for order in range(1, ORDER + 1):
            value, rest = got[order][back[order]], got[-order][back[-order]]
            out = np.where(np.isnan(value), out + np.nan_to_num(rest, nan=0.0), value)
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats for each character by text and language, and the number of characters; 0 without letters."""
        out, size = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        slices = list(_split(texts))
        for at in range(0, len(slices), TOGETHER):
            parts = []
            for first, last in slices[at : at + TOGETHER]:
                numbers, owner = codes(texts[first:last])
                # a text's first characters have zeros before them
                key, own = grams(*_padded(numbers, owner))
                distinct, back = np.unique(key, return_inverse=True)
                letters = np.bincount(owner, numbers != 0, last - first)
                parts.append((first, last, letters, distinct, back.astype(np.int32), own.astype(np.int32)))
            known = np.unique(np.concatenate([p[3] for p in parts]))
            found = self.log_probabilities(known)
            for first, last, letters, distinct, back, own in parts:
                logs = found[np.searchsorted(known, distinct)]
                n = np.bincount(own, minlength=last - first)
                for k in range(len(self.langs)):
                    sums = np.bincount(own, logs[back, k], last - first)
                    out[first:last, k] = -sums / np.maximum(n, 1)
                size[first:last] = np.where(letters > 0, n, 0)
        return out, size

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        entropy, size = self.entropies([t or "" for t in texts])
        best = entropy.argmin(axis=1)
        low = entropy[np.arange(len(best)), best]
        gap = entropy - low[:, None]
        told = 1.0 / np.exp(-gap * np.minimum(size, EVIDENCE)[:, None] / self.temperature).sum(axis=1)
        far = np.maximum(0, low - self.limits[best]) / self.spread[best]
        score = np.where(size > 0, told * np.exp(-far / LIMIT), 0.0)
        return [self.langs[b] if n else UNKNOWN for b, n in zip(best.tolist(), size.tolist())], score


def _padded(numbers: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two more zeros before each text, so that every character after the first zero ends a run."""
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    return np.insert(numbers, np.repeat(first, 2), 0), np.insert(owner, np.repeat(first, 2), np.repeat(owner[first], 2))


def is_held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(training: DataFrame) -> Model | None:
    """Model from (lang, text) rows; null langs and texts are ignored. None if nothing is left.

    Counts and probabilities cover all runs of all rows and are worked out as tables; the driver
    sees the names of the languages and one shard of about ``SHARD_CELLS`` values at a time.
    """
    rows = training.where("lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), *[c for c in ("doc_id",) if c in training.columns])
    counts = materialize(count_runs(rows), "language-runs")
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    if not langs:
        return None
    index = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int") - 1
    values, floor = smoothed(counts.select(index.alias("lang"), "run", "n"))
    values = materialize(values, "language-model")
    runs = values.select("kind", "run").distinct().count()
    many = -(-runs * len(langs) // SHARD_CELLS) | 1  # an odd count, as runs that end alike differ by powers of two
    context, shards = training.sparkSession.sparkContext, []
    for number in range(many):
        own = values.where(F.pmod("run", F.lit(many)) == number).toArrow()
        shards.append(context.broadcast(_arrays(own, len(langs))))
    return calibrate(Model(langs, floor, shards), rows)


def calibrate(model: Model, rows: DataFrame) -> Model:
    """Sets the limits of rejection and the temperature of the score from all training rows.

    Sums are taken in every batch: entropies of texts under their own model for the limits, and
    the log-likelihood of their own languages under each temperature, of which the best is kept.
    """
    grid = [f"t{k}" for k in range(len(TEMPERATURES))]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {name: k for k, name in enumerate(model.langs)}
        for batch in batches:
            entropy, size = model.entropies(batch.column(1).to_pylist())
            own = np.array([index[name] for name in batch.column(0).to_pylist()])
            good = np.flatnonzero(size)
            h, own, size = entropy[good], own[good], size[good]
            gap = -(h - h[np.arange(len(h)), own][:, None]) * np.minimum(size, EVIDENCE)[:, None]
            told = np.stack([-np.logaddexp.reduce(gap / t, axis=1) for t in TEMPERATURES], axis=1) if len(h) else np.zeros((0, len(grid)))
            low = h[np.arange(len(h)), own]
            langs = np.unique(own)
            sums = [[values[own == k].sum() for k in langs.tolist()] for values in (np.ones(len(low)), low, low * low, *told.T)]
            yield pa.RecordBatch.from_arrays([pa.array([model.langs[k] for k in langs.tolist()], pa.string()), *[pa.array(x, pa.float64()) for x in sums]], names=["lang", "n", "s", "q", *grid])

    schema = ", ".join(["lang string", *[f"{c} double" for c in ("n", "s", "q", *grid)]])
    sums = map_batches(rows.select("lang", "text"), measure, schema).groupBy("lang").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q", *grid)]).collect()
    for row in sums:  # one for each language
        k, mean = model.langs.index(row.lang), row.s / row.n
        model.spread[k] = max(max(0.0, row.q / row.n - mean * mean) ** 0.5, 0.02)
        model.limits[k] = mean + LIMIT * model.spread[k]
    if sums:
        model.temperature = max(zip(np.sum([[row[c] for c in grid] for row in sums], axis=0).round(6), TEMPERATURES))[1]
    return model


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, from its whole text alone.

    Null texts and texts without letters get "und" and score 0, and so does every text if nothing
    could be learned. Other columns are ignored; repeated rows stay; ties go to the first language.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    if model is None:
        return plain.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told, score = model.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(told, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return map_batches(plain, judge, "doc_id long, held_out boolean, lang_pred string, score double")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs.where(~is_held_out())))
