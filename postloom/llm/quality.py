"""Quality scores learned from preference pairs by the Bradley-Terry model.

Of a good and a bad document the good one is preferred, with a probability that is the
logistic function of the difference of their scores. A score is a linear function of features
of the text, so the model is fitted by logistic loss on feature differences. Documents are
then cut off at a quantile of the scores.

The fit reads every labelled document. Sums over rows and pairs are taken in tasks, as whole numbers, so that they do not
depend on how rows are dealt; a few hundred numbers of each step reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.llm import bpe
from postloom.llm.samples import labelled
from postloom.session import cut as write
from postloom.session import small_batches

PAIRS = 40_000  # at least; as many as the larger class has rows, if that is more
CHUNK, FEWEST = 512, 64  # rows of the larger class that are paired in one go, and of the smaller one, about
CELLS = 1_024  # of a histogram
UNIT = float(1 << 24)  # sums are taken in whole numbers of 1 / UNIT
CUT = 0.3  # the score at the quantile that separates

FEATURES = (
    "letters", "digits", "capitals", "spaces", "stops", "exclamations", "bars", "symbols", "beyond_ascii",
    "word_length", "odd_words", "new_words", "repeated_triples", "repeated_lines", "words_per_stop", "doubled_words",
    "size",
)

_KIND = np.full(256, 7, dtype=np.int64)  # symbols
_KIND[[*range(0x61, 0x7B)]] = 0
_KIND[[*range(0x41, 0x5B)]] = 1
_KIND[[*range(0x30, 0x3A)]] = 2
_KIND[[9, 10, 11, 12, 13, 32]] = 3
_KIND[[*b".,;:'\"-()"]] = 4
_KIND[[*b"!?"]] = 5
_KIND[[*b"|"]] = 6
_KIND[128:] = 8
_ODD = bytes(32 if _KIND[b] in (0, 1, 2, 8) or b in b".,;:'\"-()!?" else 33 for b in range(256))


def features(text: str | None) -> np.ndarray:
    """Numbers that describe the form of a whole text and how long it is, not its language or topic."""
    data = (text or "").encode("utf-8", "surrogatepass")
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=9).astype(float)
    total = max(1.0, kinds.sum())
    letters = kinds[0] + kinds[1]
    words = data.lower().split()
    count = max(1, len(words))
    triples = max(1, len(words) - 2)
    lines = [line for line in data.split(b"\n") if line.strip()]
    odd = sum(1 for w in words if not w[-1:].isalnum() and w[-1] < 128 and _KIND[w[-1]] in (5, 6, 7))
    return np.array(
        [
            letters / total,
            kinds[2] / total,
            kinds[1] / max(1.0, letters),
            kinds[3] / total,
            kinds[4] / total,
            kinds[5] / total,
            kinds[6] / total,
            kinds[7] / total,
            kinds[8] / total,
            (total - kinds[3]) / count,
            odd / count,
            len(set(words)) / count**0.8,
            1 - len(set(zip(words, words[1:], words[2:], strict=False))) / triples if len(words) > 2 else 0.0,
            1 - len(set(lines)) / max(1, len(lines)),
            math.log1p(count / (1 + data.count(b"."))),
            sum(map(eq, words, words[1:])) / count,
            math.log1p(count),
        ]
    )


@dataclass
class QualityModel:
    """Weights over standardised features, and the line that maps scores to (0, 1)."""

    middle: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    slope: float
    threshold: float  # raw score at the chosen quantile; maps to ``cut``
    cut: float

    def raw(self, rows: np.ndarray) -> np.ndarray:
        scaled = np.clip((rows - self.middle) / self.spread, -8, 8)
        return (scaled * self.weights).sum(axis=1)  # of a row the same whatever rows are beside it

    def score(self, rows: np.ndarray) -> np.ndarray:
        line = self.slope * (self.raw(rows) - self.threshold) + math.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(line, -40, 40)))


def newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], width: int, penalty: float) -> np.ndarray:
    """Weights of least loss. ``sums`` gives for weights the sums over all pairs of the differences times the
    probability of the wrong order, and of their products times its variance."""
    weights = np.zeros(width)
    for _ in range(25):
        pull, curve = sums(weights)
        step = np.linalg.solve(curve + penalty * np.eye(width), penalty * weights - pull)
        weights -= step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def wrong(apart: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The probability that the worse of two is preferred."""
    return 1 / (1 + np.exp(np.clip((apart * weights).sum(axis=1), -40, 40)))


def pair_up(good: np.ndarray, bad: np.ndarray, pairs: int, seed: int) -> np.ndarray:
    """Differences of random pairs of a good and a bad row. Every row is used before one is used again."""
    random = np.random.default_rng(seed)
    many = max(pairs, len(good), len(bad))
    left = np.resize(random.permutation(len(good)), many)
    right = random.permutation(np.resize(random.permutation(len(bad)), many))
    return good[left] - bad[right]


def fit_pairs(
    rows: np.ndarray, good: np.ndarray, pairs: int = PAIRS, penalty: float = 1.0, seed: int = 5,
    reject: float | None = None, cut: float = CUT,
) -> QualityModel | None:
    """Bradley-Terry weights from ``pairs`` random pairs of a good and a bad row.

    ``reject`` is the quantile of the scores (of these rows) to cut at; by default the share of
    bad rows. None if one of the classes is empty.
    """
    better, worse = np.nonzero(good)[0], np.nonzero(~good)[0]
    if not len(better) or not len(worse):
        return None
    middle, spread = np.median(rows, axis=0), rows.std(axis=0) + 1e-9
    scaled = np.clip((rows - middle) / spread, -8, 8)
    apart = pair_up(scaled[better], scaled[worse], pairs, seed)

    def sums(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lost = wrong(apart, weights)
        return apart.T @ lost, (apart * (lost * (1 - lost))[:, None]).T @ apart

    weights = newton(sums, rows.shape[1], penalty)
    raw = scaled @ weights
    level = (~good).mean() if reject is None else reject
    threshold = float(np.quantile(raw, level, method="midpoint"))
    deviation = float(np.abs(raw - threshold).mean()) or 1.0
    return QualityModel(middle, spread, weights, 3.0 / deviation, threshold, cut)


def feature_rows(documents: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """``keep`` and the features of every row."""
    small_batches(documents.sparkSession)
    schema = T.StructType(
        [documents.schema[c] for c in keep] + [T.StructField("features", T.ArrayType(T.DoubleType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.forget()
        for batch in batches:
            rows = [features(t.as_py()) for t in batch.column(len(keep))]
            found = pa.array(rows, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], found], names=schema.names)

    return documents.select(*keep, text_col).mapInArrow(run, schema)


def labelled_features(documents: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, y, features)`` of every labelled id. Of rows with one id a single one counts, that of the smallest text
    hash. Features are worked out first, so that no text is shuffled."""
    rows = documents.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    found = feature_rows(rows.where("id is not null"), ["id", "text_key"], "text")
    row = F.min(F.struct("text_key", "features")).alias("row")
    joined = found.join(known.withColumnRenamed(id_col, "id"), "id").groupBy("id", "y").agg(row)
    return write(joined.select("id", "y", F.col("row.features").alias("features")), "quality-rows")


def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every feature, from exact decimal sums. A feature is a row: one aggregate with two sums for each of them
    would be one huge method, and compiling that takes more memory than the sums."""
    def total(value: Column, name: str) -> Column:
        return F.sum(value.cast("decimal(28,10)")).alias(name)

    value = F.col("value")
    each = rows.select(F.posexplode("features").alias("k", "value")).groupBy("k")
    found = each.agg(F.count(F.lit(1)).alias("rows"), total(value, "x"), total(value * value, "xx")).orderBy("k").collect()
    middle = np.array([float(r["x"]) for r in found]) / found[0]["rows"]
    square = np.array([float(r["xx"]) for r in found]) / found[0]["rows"]
    return middle, np.sqrt(np.maximum(square - middle**2, 0)) + 1e-9


def paired(rows: DataFrame, counts: dict[int, int], middle: np.ndarray, spread: np.ndarray, pairs: int, seed: int) -> DataFrame:
    """``(apart)``: differences of at least ``pairs`` random pairs in which every row takes part.

    The larger class is dealt into chunks of some ``CHUNK`` rows. The smaller class is dealt into as many parts, or into fewer that
    hold ``FEWEST`` rows each, and a chunk is paired with one part, so no group grows with the table.
    """
    small_y, large_y = sorted((0, 1), key=lambda y: (counts[y], y))
    chunks = -(-counts[large_y] // CHUNK)
    parts = max(1, min(chunks, counts[small_y] // FEWEST))
    draw = F.xxhash64(F.lit(seed), "id")
    large = rows.where(F.col("y") == large_y).withColumn("chunk", F.pmod(draw, F.lit(chunks)))
    part = F.pmod(draw, F.lit(parts))
    small = rows.where(F.col("y") == small_y).withColumn(
        "chunk", F.explode(F.sequence(part, F.lit(chunks - 1).cast("long"), F.lit(parts).cast("long")))
    )
    each = -(-pairs // chunks)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        values = np.array(group.column("features").combine_chunks().flatten()).reshape(-1, len(middle))
        scaled = np.clip((values - middle) / spread, -8, 8)
        y = group.column("y").to_numpy()
        order = np.lexsort((*scaled.T, y))  # the same pairs for any arrival order
        scaled, y = scaled[order], y[order]
        good, bad = scaled[y == 1], scaled[y == 0]
        apart = pair_up(good, bad, each, seed + key[0].as_py()) if len(good) and len(bad) else scaled[:0]
        return pa.table({"apart": pa.FixedSizeListArray.from_arrays(pa.array(apart.ravel()), len(middle)).cast(pa.list_(pa.float64()))})

    both = large.unionByName(small).select("chunk", "y", "features")
    return write(both.groupBy("chunk").applyInArrow(run, "apart array<double>"), "quality-pairs")


def pair_sums(pairs: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums of :func:`newton` over a table of pairs."""
    width = len(weights)
    a, b = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width + len(a), np.int64)
        for batch in (x.slice(i, CHUNK) for x in batches for i in range(0, x.num_rows, CHUNK)):
            apart = batch.column("apart").flatten().to_numpy().reshape(-1, width)
            lost = wrong(apart, weights)
            total[:width] += np.rint(apart * lost[:, None] * UNIT).astype(np.int64).sum(axis=0)
            bent = apart[:, a] * apart[:, b] * (lost * (1 - lost))[:, None]
            total[width:] += np.rint(bent * UNIT).astype(np.int64).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["place", "total"])

    found = pairs.mapInArrow(run, "place long, total long").groupBy("place").agg(F.sum("total").alias("total")).collect()
    total = np.zeros(width + len(a))
    for r in found:
        total[r["place"]] = r["total"] / UNIT
    curve = np.zeros((width, width))
    curve[a, b] = curve[b, a] = total[width:]
    return total[:width], curve


def ranked(values: DataFrame, rank: int) -> float:
    """The value at this rank, from 1, of a column ``raw``. In a round the histogram of what is left narrows it down."""
    low, high = values.agg(F.min("raw"), F.max("raw")).first()
    while low < high:
        cell = F.least(F.floor((F.col("raw") - low) / (high - low) * CELLS), F.lit(CELLS - 1)).alias("cell")
        within = values.where(F.col("raw").between(low, high)).groupBy(cell)
        cells = within.agg(F.count(F.lit(1)).alias("rows"), F.min("raw").alias("low"), F.max("raw").alias("high"))
        for r in sorted(cells.collect()):
            if rank <= r["rows"]:
                low, high = r["low"], r["high"]
                break
            rank -= r["rows"]
    return low


def train(
    documents: DataFrame,
    labels: DataFrame,
    where: Column | None = None,
    label: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 5,
    pairs: int = PAIRS,
    penalty: float = 1.0,
) -> QualityModel | None:
    """Fit on every labelled document. Of rows with one id a single one counts, that of the
    smallest text hash. ``where`` limits the labels that are read.
    The cut-off quantile is the share of bad documents among them. None if one of the classes is empty."""
    known = labelled(labels, label, where, id_col)
    if known.select("y").distinct().count() < 2:
        return None
    rows = labelled_features(documents, known, id_col, text_col)
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(counts) < 2:
        return None
    middle, spread = moments(rows)
    apart = paired(rows, counts, middle, spread, pairs, seed)
    weights = newton(lambda w: pair_sums(apart, w), len(FEATURES), penalty)
    model = QualityModel(middle, spread, weights, 1.0, 0.0, CUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("features").flatten().to_numpy().reshape(-1, len(middle))
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(values))], names=["raw"])

    raw = write(rows.select("features").mapInArrow(run, "raw double"), "quality-raw")
    model.threshold = (ranked(raw, counts[0]) + ranked(raw, counts[0] + 1)) / 2
    apart_from = F.floor(F.abs(F.col("raw") - model.threshold) * UNIT)
    deviation = raw.agg(F.sum(apart_from).alias("sum")).first()["sum"] / UNIT / sum(counts.values())
    model.slope = 3.0 / (deviation or 1.0)
    return model


def score_documents(
    documents: DataFrame,
    model: QualityModel | None,
    keep: list[str] | None = None,
    text_col: str = "text",
    name: str = "score",
) -> DataFrame:
    """``keep`` and the score of every row: between 0 and 1, higher for better documents, and
    ``model.cut`` at the quantile the model cuts at.

    * Null or empty texts get the score of a text without words. Texts are read whole, whatever
      their length. Without a model (no labels, or labels of one class) every score is 0.5.
      Repeated rows and nulls in ``keep`` stay as they are; other columns are ignored; an empty
      table gives an empty result.
    """
    keep = ["doc_id"] if keep is None else keep
    schema = T.StructType([documents.schema[c] for c in keep] + [T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.forget()
        for batch in batches:
            if model is None:
                scores = np.full(batch.num_rows, 0.5)
            elif batch.num_rows:
                scores = model.score(np.array([features(t.as_py()) for t in batch.column(len(keep))]))
            else:
                scores = np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(scores, pa.float64())], names=schema.names
            )

    return documents.select(*keep, text_col).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0
