"""Ranked lexical search over a length-stratified index.

A document's length enters its score only through a small integer, its normaliser ``m``. Documents of equal ``m``
form a stratum, and in a stratum the documents that hold a term are listed by ``tf``. So all
documents of one list have the same impact, which is computed once for the list. The impact grows with
``tf``, so the last list of a term bounds what the term can add in the stratum; a query visits the strata
in descending order of the sum of its bounds and stops where that sum is below its k-th score.

Two passes: the texts are read once and become short rows of (term, tf) for the terms of the queries; these are dealt
to shards by ranges of ``m``, each shard builds its index in bounded blocks and searches it for every
query, and the best of all shards are merged.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.session import cut

ITEMS_PER_BLOCK, BYTES_PER_BLOCK = 1024, 16 << 20  # queries that are searched together
ROWS_PER_SHARD = 20_000
ROWS_PER_INDEX = 1 << 16  # documents that are indexed at once in a task

_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_LOWER = bytes(range(0x41, 0x5B))
# Everything ASCII but letters and digits parts terms; of letters only A-Z are lower-cased.
_TABLE = bytes(0x20 if b in _SEPARATORS else b + 0x20 if b in _LOWER else b for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Terms of one text in order, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def postings(documents: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``(id, n, terms, tfs)`` of every row with a term: its length, and the terms of ``vocabulary`` in it."""
    schema = T.StructType.fromDDL("id long, n long, terms array<int>, tfs array<bigint>")

    def lists(values: list[list[int]], kind) -> pa.Array:
        ends = pa.array(np.cumsum([0, *map(len, values)]), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array([x for v in values for x in v], kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.keys()
        for batch in batches:
            ids, sizes, terms, tfs = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = terms_of(text.as_py())
                if not words:
                    continue
                counts = Counter(words)
                held = sorted((vocabulary[t], counts[t]) for t in counts.keys() & known)
                ids.append(i)
                sizes.append(len(words))
                terms.append([t for t, _ in held])
                tfs.append([f for _, f in held])
            columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), lists(terms, pa.int32()), lists(tfs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return documents.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, schema)


class Strata:
    """Index of one block of documents, sorted by (m, term, tf)."""

    def __init__(self, m: np.ndarray, docs: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray):
        """``m`` of each document; ``docs, terms, tfs`` of each posting; ``weights`` of each term."""
        self.vocabulary = len(weights)
        self.normalisers, stratum = np.unique(m, return_inverse=True)
        self.by_stratum = np.argsort(stratum, kind="stable")
        sizes = np.bincount(stratum, minlength=len(self.normalisers))
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        place = np.empty(len(m), np.int64)
        place[self.by_stratum] = np.arange(len(m))
        key = stratum[docs] * self.vocabulary + terms
        order = np.lexsort((tfs, key))
        key, tf = key[order], tfs[order]
        self.docs = place[docs[order]]
        # One impact for each list of (stratum, term, tf).
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (tf[1:] != tf[:-1])])) if len(key) else np.empty(0, np.int64)
        lengths = np.diff(np.append(first, len(key)))
        normaliser = self.normalisers[key[first] // self.vocabulary]
        impact = weights[key[first] % self.vocabulary] * ((10**9 * tf[first]) // (1000 * tf[first] + 12 * normaliser))
        self.impacts = np.repeat(impact, lengths)
        self.keys, self.heads = np.unique(key, return_index=True)
        self.tails = np.append(self.heads[1:], len(key))
        self.bounds = self.impacts[self.tails - 1] if len(key) else impact

    def search(self, terms: np.ndarray, times: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Documents and scores, at least ``least`` and above 0, stratum by stratum. The caller may
        send a higher ``least``."""
        if not len(self.keys):
            return
        wanted = np.arange(len(self.normalisers))[:, None] * self.vocabulary + terms[None, :]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        held = self.keys[at] == wanted
        bound = (np.where(held, self.bounds[at], 0) * times[None, :]).sum(axis=1)
        for s in np.argsort(-bound, kind="stable"):
            if bound[s] < max(least, 1):
                return
            low, high = self.starts[s], self.starts[s + 1]
            scores = np.zeros(high - low, np.int64)
            for j in np.flatnonzero(held[s]):
                part = slice(self.heads[at[s, j]], self.tails[at[s, j]])
                scores[self.docs[part] - low] += times[j] * self.impacts[part]
            good = np.flatnonzero(scores >= max(least, 1))
            if len(good):
                raised = yield self.by_stratum[low + good], scores[good]
                least = least if raised is None else raised


def _best(found: tuple, more: tuple, k: int) -> tuple:
    """The ``k`` best of two lists (score, null id, id): high scores first, then small ids, nulls last."""
    score, null, ident = (np.concatenate([a, b]) for a, b in zip(found, more, strict=True))
    if len(score) > 4 * k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        keep = score >= edge
        score, null, ident = score[keep], null[keep], ident[keep]
    order = np.lexsort((ident, null, -score))[:k]
    return score[order], null[order], ident[order]


def search_shards(index: DataFrame, queries: list[Counter], weights: np.ndarray, k: int) -> DataFrame:
    """``(query, id, score)``: the best of every shard. ``index`` has ``id, m, terms, tfs``."""
    schema = T.StructType.fromDDL("query int, id long, score long")
    wanted = [(np.array(sorted(q), np.int64), np.array([q[t] for t in sorted(q)], np.int64)) for q in queries]
    nothing = (np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, rows = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_PER_INDEX):
                piece = batch.slice(start, ROWS_PER_INDEX)
                if rows and rows + piece.num_rows > ROWS_PER_INDEX:
                    yield pa.Table.from_batches(held)
                    held, rows = [], 0
                held.append(piece)
                rows += piece.num_rows
        if rows:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [nothing] * len(wanted)
        for block in blocks(batches):
            block = block.combine_chunks()
            ids = block["id"].combine_chunks()
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ident = ids.fill_null(0).to_numpy(zero_copy_only=False)
            terms = block["terms"].combine_chunks()
            sizes = terms.value_lengths().to_numpy(zero_copy_only=False)
            strata = Strata(
                block["m"].combine_chunks().to_numpy(zero_copy_only=False),
                np.repeat(np.arange(len(sizes)), sizes),
                terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
                block["tfs"].combine_chunks().flatten().to_numpy(zero_copy_only=False),
                weights,
            )
            for q, (query_terms, times) in enumerate(wanted):
                def least(q=q) -> int:
                    return int(best[q][0][-1]) if len(best[q][0]) == k else 1

                visits = strata.search(query_terms, times, least())
                hit = next(visits, None)
                while hit is not None:
                    docs, scores = hit
                    best[q] = _best(best[q], (scores, null[docs], ident[docs]), k)
                    try:
                        hit = visits.send(least())
                    except StopIteration:
                        hit = None
        for q, (score, null, ident) in enumerate(best):
            if len(score):
                columns = [pa.array(np.full(len(score), q), pa.int32()), pa.array(ident, mask=null), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return index.mapInArrow(run, schema)


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    block, size = [], 0
    for item, text in items.select(id_col, text_col).toLocalIterator():
        if block and (len(block) == ITEMS_PER_BLOCK or size + len(text or "") > BYTES_PER_BLOCK):
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(text or "")
    if block:
        yield block


def lexical_ranks(
    documents: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``(item_col, rank, id_col, score)``: for every row of ``items`` the ``k`` rows of ``documents`` with the
    highest score above 0, equal scores by ascending id.

    With N documents that hold a term, L terms in all and df documents of a term, the term weighs
    ``w = floor(1000 ln((2 N + 2) / (2 df + 1)))``; a document of n terms has ``m = 75 + 25 n N div L`` and
    scores ``w (10^9 tf div (1000 tf + 12 m))`` for each term of the item, repeats included.

    * Null and empty texts hold no term: such documents count nowhere and such items have no rows. Of
      rows with one id each counts and is ranked for itself; null ids come last among equal scores.
      Other columns are ignored. Empty tables give an empty result.
    * Items are searched in blocks of up to 1,024 (or 16 MB of text); each block reads the documents once.
      Documents of one normaliser, or one id, are spread over shards by their place in the table, and a task indexes
      65,536 of them at a time.
    """
    spark = documents.sparkSession
    out = T.StructType(
        [
            T.StructField(item_col, items.schema[item_col].dataType),
            T.StructField("rank", T.IntegerType()),
            T.StructField(id_col, T.LongType()),
            T.StructField("score", T.LongType()),
        ]
    )
    ranked = spark.createDataFrame([], out)
    for block in _blocks(items, item_col, item_text_col):
        counted = [Counter(terms_of(text)) for _, text in block]
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counted)))}
        if not vocabulary:
            continue
        lists = cut(postings(documents, vocabulary, id_col, text_col), "postings")
        n_docs, n_terms = lists.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            return ranked
        df = np.zeros(len(vocabulary), np.int64)
        held = lists.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        for row in held.toLocalIterator():  # no more rows than terms in the block's items
            df[row["term"]] = row["df"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        queries = [Counter({vocabulary[t]: c for t, c in q.items()}) for q in counted]
        m: Column = F.lit(75) + F.expr(f"(25 * n * {n_docs}L) div {n_terms}L")
        index = lists.where(F.size("terms") > 0).select("id", m.cast("long").alias("m"), "terms", "tfs")
        shards = max(1, math.ceil(n_docs / ROWS_PER_SHARD))
        place = F.monotonically_increasing_id()
        index = index.withColumn("place", place).repartitionByRange(shards, "m", "place").drop("place")
        found = search_shards(index, queries, weights, k)
        names = [(q, item) for q, (item, _) in enumerate(block)]
        names = spark.createDataFrame(names, T.StructType([T.StructField("query", T.IntegerType()), out[item_col]]))
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        top = top.join(F.broadcast(names), "query").select(item_col, "rank", F.col("id").alias(id_col), "score")
        ranked = ranked.unionByName(top)
    return ranked
