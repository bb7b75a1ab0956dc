"""Toxicity categories by a classifier chain.

Categories are predicted one after another by linear models. A later model gets the
probabilities of the earlier categories as features; while it is trained these come from models
that have not seen the row (out-of-fold), so that it meets them as uncertain as they will be.

The terms the models look at are words, and beginnings of words, that are found among labelled
toxic documents much more often than elsewhere.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.llm import bpe
from postloom.llm.samples import labelled, sample, with_texts
from postloom.session import cut

TOXIC_ROWS, OTHER_ROWS = 3_000, 6_000  # labelled documents the models are fitted on, about
STARTS = (4, 5, 6)  # lengths of the beginnings of words, in bytes
MAX_TERMS, USED_TERMS = 600, 160  # before and after those that say the same are left out
LEAST_LIFT, LEAST_GAIN = 6.0, 20.0
CACHED_WORDS = 170_000  # a dict doubles at 174,763
FOLDS = 5
TOXIC_FROM = 0.3  # probability of the last category from which a text counts as toxic

# The chain, in its order: the share of toxic terms is high; they recur; the text is toxic.
CATEGORIES = ("dense", "recurring", "toxic")
DENSE, RECURRING = 0.01, 3

_LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words of a whole text: runs of letters; bytes beyond ASCII count as letters."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def terms_of(word: bytes) -> list[bytes]:
    """The word, and its beginnings with a star."""
    return [word, *[word[:n] + b"*" for n in STARTS if len(word) > n]]


class TermCache(dict):
    """Words and the numbers of the terms they match; forgets all when it is full."""

    def __init__(self, terms: list[bytes]):
        super().__init__()
        self.number = {t: i for i, t in enumerate(terms)}

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = tuple(self.number[t] for t in terms_of(word) if t in self.number)
        self[word] = found
        return found


def matches(text: str | None, cache: TermCache) -> tuple[list[int], list[int], int, int]:
    """Numbers of the terms in a text, how often each occurs, how many words match any term, and
    how many words there are."""
    words = words_of(text)
    hits = [found for found in map(cache.__getitem__, words) if found]
    counts = sorted(Counter(i for found in hits for i in found).items())
    return [i for i, _ in counts], [n for _, n in counts], len(hits), len(words)


def surprise(
    rows: list[tuple[list[int], list[int], int, int]], rates: np.ndarray
) -> np.ndarray:
    """One column per term: how often it occurs, against what a text of that length from the
    other documents would have, as a logarithm. Absent: 0. Once, and never elsewhere: 1."""
    found = np.zeros((len(rows), len(rates)))
    for row, (terms, counts, _, words) in zip(found, rows, strict=True):
        row[terms] = np.log2(1 + np.array(counts) / (1 + words * rates[terms]))
    return found


@dataclass
class ToxicityModel:
    """Terms with their rates among other documents, and one row of weights per category:
    terms, earlier categories, constant."""

    terms: list[bytes]
    rates: np.ndarray
    categories: tuple[str, ...]
    weights: list[np.ndarray]

    def probabilities(self, terms: np.ndarray) -> np.ndarray:
        """One column per category, in the order of the chain."""
        found = np.zeros((len(terms), 0))
        for weights in self.weights:
            found = np.column_stack([found, _apply(weights, terms, found)])
        return found


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _apply(weights: np.ndarray, terms: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    width = terms.shape[1]
    return _logistic(terms @ weights[:width] + earlier @ weights[width:-1] + weights[-1])


def _fit(terms: np.ndarray, earlier: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small penalty, by Newton's method."""
    rows = np.column_stack([terms, earlier, np.ones(len(y))])
    share = weight / weight.sum()
    penalty = np.full(rows.shape[1], 1e-4)
    penalty[-1] = 1e-9
    at = np.zeros(rows.shape[1])
    for _ in range(15):
        chance = _logistic(rows @ at)
        slope = rows.T @ (share * (chance - y)) + penalty * at
        curve = (rows * (share * np.maximum(chance * (1 - chance), 1e-6))[:, None]).T @ rows
        step = np.linalg.solve(curve + np.diag(penalty), slope)
        at = at - step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-4:
            break
    return at


def fit_chain(
    terms: np.ndarray, targets: np.ndarray, fold: np.ndarray, weight: np.ndarray, folds: int = FOLDS
) -> list[np.ndarray]:
    """One model per column of ``targets``, in order. What a model learns about the earlier
    categories are predictions of models fitted without the row's fold."""
    earlier = np.zeros((len(terms), 0))
    models = []
    for column in range(targets.shape[1]):
        y = targets[:, column].astype(float)
        models.append(_fit(terms, earlier, y, weight))
        if column + 1 == targets.shape[1]:
            break
        guess = np.full(len(y), float((weight * y).sum() / weight.sum()))
        for k in range(folds):
            out = fold == k
            if out.any() and not out.all():
                fitted = _fit(terms[~out], earlier[~out], y[~out], weight[~out])
                guess[out] = _apply(fitted, terms[out], earlier[out])
        earlier = np.column_stack([earlier, guess])
    return models


def telling_terms(texts: DataFrame, text_col: str, most: int = MAX_TERMS) -> list[bytes]:
    """Terms of the sample that speak for toxicity, by likelihood ratio; ``most`` at most.

    Tasks count terms of their own texts; the counts are added up by term, and only the best
    terms reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = set(words_of(text.as_py()))
                counts[y].update({t for w in words for t in terms_of(w)})
        terms = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(terms, pa.binary()),
                pa.array([counts[1][t] for t in terms], pa.int64()),
                pa.array([counts[0][t] for t in terms], pa.int64()),
            ],
            names=["term", "toxic", "other"],
        )

    counted = texts.select(text_col, "y").mapInArrow(run, "term binary, toxic long, other long")
    total = {r["y"]: r["count"] for r in texts.groupBy("y").count().collect()}
    if not total.get(0) or not total.get(1):
        return []
    sums = [F.sum(c).alias(c) for c in ("toxic", "other")]
    lift = ((F.col("toxic") + 0.5) / (total[1] + 1)) / ((F.col("other") + 0.5) / (total[0] + 1))
    part = total[1] / (total[0] + total[1])
    both = F.col("toxic") + F.col("other")
    gain = 2 * (
        F.col("toxic") * F.log(F.col("toxic") / (both * part))
        + F.when(F.col("other") > 0, F.col("other") * F.log(F.col("other") / (both * (1 - part)))).otherwise(0)
    )
    best = (
        counted.groupBy("term")
        .agg(*sums)
        .where(F.col("toxic") > 2)
        .withColumn("lift", lift)
        .withColumn("gain", gain)
        .where((F.col("lift") >= LEAST_LIFT) & (F.col("gain") >= LEAST_GAIN))
        .orderBy(F.desc("gain"), "term")
        .limit(most)
    )
    return [bytes(r["term"]) for r in best.collect()]


def term_rows(documents: DataFrame, terms: list[bytes], keep: list[str], text_col: str) -> DataFrame:
    """``keep``, the terms of a text with their counts, matching words and words."""
    schema = T.StructType(
        [documents.schema[c] for c in keep]
        + [
            T.StructField("terms", T.ArrayType(T.IntegerType())),
            T.StructField("counts", T.ArrayType(T.IntegerType())),
            T.StructField("hits", T.LongType()),
            T.StructField("words", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.forget()
        cache = TermCache(terms)
        for batch in batches:
            rows = [matches(t.as_py(), cache) for t in batch.column(len(keep))]
            columns = zip(*rows, strict=True) if rows else ([], [], [], [])
            kinds = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64())
            found = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *found], names=schema.names)

    return documents.select(*keep, text_col).mapInArrow(run, schema)


def train(
    documents: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    toxic_rows: int = TOXIC_ROWS,
    other_rows: int = OTHER_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 3,
    found_terms: int = MAX_TERMS,
    used_terms: int = USED_TERMS,
) -> ToxicityModel | None:
    """Fit the chain on about ``toxic_rows`` toxic and ``other_rows`` other labelled documents:
    a bounded sample, one document per text. Rows are weighted back to the share of their class.
    Of the terms that tell, the best ``found_terms`` are looked at, and the first ``used_terms`` of those that
    occur in different documents are the model's features.

    The labels know only toxic or not. The first two categories refine it by what the terms
    say: ``dense`` (at least 1 % of the words match a term) and ``recurring`` (three or more
    do), each of toxic documents only. None if a class has no documents or no term tells.
    """
    known = labelled(labels, label, None, id_col)
    chosen = sample(known, {1: toxic_rows, 0: other_rows}, id_col, seed)
    texts = with_texts(documents, chosen, id_col, text_col)
    same = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    # The smallest id of each text, so that the model does not depend on which row comes first.
    texts = texts.groupBy(same.alias("same")).agg(
        F.min_by(F.struct(*texts.columns), id_col).alias("row")
    ).select("row.*")
    texts = cut(texts, "toxicity-sample")
    terms = telling_terms(texts, text_col, found_terms)
    if not terms:
        return None
    fold = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(FOLDS)).cast("int").alias("fold")
    rows = texts.select(F.col(id_col).alias("id"), text_col, "y", "share", fold)
    found = term_rows(rows, terms, ["id", "y", "share", "fold"], text_col).toArrow()
    found = found.sort_by([("id", "ascending")])  # the same model in any order of arrival
    names = ("terms", "counts", "hits", "words")
    rows = list(zip(*[found[c].to_pylist() for c in names], strict=True))
    y = found["y"].to_numpy() == 1
    rates = np.zeros(len(terms))
    for (numbers, counts, _, _), toxic in zip(rows, y, strict=True):
        if not toxic:
            rates[numbers] += counts
    rates /= max(1, sum(r[3] for r, toxic in zip(rows, y, strict=True) if not toxic))
    # Of terms that occur in the same documents of the sample the first stands for all.
    _, first = np.unique(surprise(rows, rates) > 0, axis=1, return_index=True)
    used = np.sort(first)[:used_terms]
    matrix = surprise(rows, rates)[:, used]
    terms, rates = [terms[i] for i in used], rates[used]
    hits, words = found["hits"].to_numpy(), np.maximum(1, found["words"].to_numpy())
    targets = np.column_stack([y & (hits / words >= DENSE), y & (hits >= RECURRING), y])
    models = fit_chain(matrix, targets, found["fold"].to_numpy(), 1 / found["share"].to_numpy())
    return ToxicityModel(terms, rates, CATEGORIES, models)


def score_documents(
    documents: DataFrame,
    model: ToxicityModel | None,
    keep: list[str] | None = None,
    text_col: str = "text",
) -> DataFrame:
    """``keep`` and the probability of each category, ``p_dense``, ``p_recurring``, ``p_toxic``.

    * Null or empty texts match no term and get the probabilities of a text without any. Texts
      are read whole, whatever their length. Without a model every probability is 0. Repeated
      rows and nulls in ``keep`` stay as they are; other columns are ignored; an empty table
      gives an empty result.
    """
    keep = ["doc_id"] if keep is None else keep
    names = [f"p_{c}" for c in CATEGORIES]
    schema = T.StructType(
        [documents.schema[c] for c in keep] + [T.StructField(n, T.DoubleType()) for n in names]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.forget()
        cache = TermCache(model.terms if model else [])
        for batch in batches:
            found = np.zeros((batch.num_rows, len(names)))
            if model and batch.num_rows:
                rows = [matches(t.as_py(), cache) for t in batch.column(len(keep))]
                found = model.probabilities(surprise(rows, model.rates))
            columns = [pa.array(found[:, i], pa.float64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=schema.names)

    return documents.select(*keep, text_col).mapInArrow(run, schema)
