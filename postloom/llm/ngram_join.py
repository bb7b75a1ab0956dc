"""Jaccard join of texts on their word n-grams: size-aware, heavy and light sets apart.

Two sets of shingles link if their Jaccard similarity is 0.8 or more. Then they share at least
``c = ceil(0.8 n)`` elements of a set of size ``n``, so, in one order of all shingles, they share ``q`` elements within the
first ``n - c + q`` of each. That is used in two ways, by size:

* a **light** set enumerates all subsets of size two of its first ``n - c + 2`` shingles, and light sets meet in equal
  subsets. Subsets are rare, so hardly any sets meet in vain, but their number grows with the square of ``n``;
* a **heavy** set scans the inverted lists of its first ``n - c + 1`` shingles. Light sets that can be alike to
  a heavy one are in those lists as well.

The boundary is the size at which the expected cost is least: rows to shuffle and sets met, as counted on a sample.
The sample also puts common shingles last in the order. Neither changes which links are found.

Sets that meet are compared step by step, because only connected groups are wanted: first every set of
a bucket with one leader, then, where a bucket still holds several groups, with a few more leaders, and last
the sets outside the largest group of a bucket with all others of it. Sizes, the places of the bucket's shingle
in the two sets, and parities, a few bits for each shingle, rule out nearly all pairs that are not alike, before they are
made; the others are verified on whole sets, which are read from the texts of just those documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.llm import bpe
from postloom.llm.graph import components
from postloom.operators.ordered import lookup_join, shuffled, small
from postloom.session import cut, discard, small_batches

SEED = 42
WIDTH = 5
SAMPLE, COMMON = 8_000, 1 << 17  # texts in the sample, and common shingles that are put last, at most
SUBSET = 2  # size of the subsets of light sets; smaller sets than 4 link only with equal ones
LIGHTEST = 100  # a set above this size has over 200 subsets and 20 lists: it is heavy at any cost
MEETING = 8  # cost of two sets that meet, in rows shuffled
LEADERS = 4
PRIOR = 8  # buckets of a set that are looked back at
FILTER_BITS = 26  # bit filters have 8 MB, whatever the table
MEMBERS_PER_TASK = 512  # sets compared with one leader's set in one go
BITS = ["b0", "b1", "b2", "b3"]


# --- sets of one text ------------------------------------------------------------------


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles of one text, sorted. Fewer words than ``width`` make one
    shingle of them all, no word makes none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < width:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = map(b" ".join, zip(*[words[k:] for k in range(width)], strict=False))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, SEED) for s in shingles), dtype=np.uint64))


def needed(n: int) -> int:
    """Shingles that a set of size ``n`` shares with any set alike, at least."""
    return -(-4 * n // 5)


class Order:
    """The order of all shingles: those that are common in the sample last, else by hash."""

    def __init__(self, common: np.ndarray):
        """``common``: hashes, rarest first."""
        self.place = np.argsort(common)
        self.hashes = common[self.place]

    def first(self, hashes: np.ndarray, length: int) -> np.ndarray:
        rank = np.zeros(len(hashes), np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            rank = np.where(self.hashes[at] == hashes, self.place[at] + 1, 0)
        return hashes[np.lexsort((hashes, rank))][:length]


def subset_marks(hashes: np.ndarray, order: Order) -> np.ndarray:
    """Hashes of the subsets of size two of the first shingles of a set."""
    n = len(hashes)
    if n < 4:
        return hashes[:0]
    first = order.first(hashes, n - needed(n) + SUBSET)
    a, b = np.triu_indices(len(first), 1)
    low, high = first[a], first[b]
    return low * np.uint64(0x9E3779B97F4A7C15) + (high ^ (high >> np.uint64(29))) * np.uint64(0xD1B54A32D192ED03)


def list_marks(hashes: np.ndarray, order: Order) -> np.ndarray:
    """The shingles whose inverted lists a set is in."""
    n = len(hashes)
    return order.first(hashes, n - needed(n) + 1) if n >= 4 else hashes[:0]


def places(sizes: np.ndarray, lengths: np.ndarray, boundary: int) -> np.ndarray:
    """The place of every mark of these sets in the order of all shingles: how many shingles of its set come before
    it. -1 for subsets, which come first in :func:`marks`."""
    first = np.minimum(sizes, sizes + SUBSET - -(-4 * sizes // 5))
    light = np.where((sizes >= 4) & (sizes <= boundary), first * (first - 1) // 2, 0)
    begin = np.cumsum(lengths) - lengths
    return np.maximum(np.arange(lengths.sum()) - np.repeat(begin + light, lengths), -1)


def marks(hashes: np.ndarray, order: Order, boundary: int) -> np.ndarray:
    """All buckets of a set: subsets if it is light, lists if it is heavy or can be alike to a heavy one."""
    n = len(hashes)
    light = subset_marks(hashes, order) if n <= boundary else hashes[:0]
    listed = list_marks(hashes, order) if 5 * n >= 4 * (boundary + 1) else hashes[:0]
    return np.concatenate([light, listed])


def parity(hashes: np.ndarray) -> np.ndarray:
    """256 bits: how often each cell is hit, modulo two. Sets differ in at least as many elements as
    their parities differ in bits."""
    odd = np.bincount((hashes & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_parity(hashes: np.ndarray) -> bytes:
    """The same with at least two cells for each element, so that it tells long sets apart as well."""
    cells = max(256, 1 << math.ceil(math.log2(2 * max(len(hashes), 1))))
    odd = np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def bits_apart(a: bytes, b: bytes) -> int:
    """Bits in which two wide parities differ; the longer one is folded to the length of the other."""
    size = min(len(a), len(b))
    one, other = (np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, size), axis=0) for x in (a, b))
    return int(np.unpackbits(one ^ other).sum())


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 80 * union, of two sorted sets."""
    if not len(a) or not len(b):
        return False
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    return 9 * int((a[at] == b).sum()) >= 4 * (len(a) + len(b))


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = pa.array(np.cumsum([0, *map(len, values)]), pa.int32())
    flat = np.concatenate([np.empty(0, np.uint64), *values]).view(np.int64)
    return pa.ListArray.from_arrays(ends, pa.array(flat, pa.int64()))


def _sets(batches: Iterator[pa.RecordBatch], column: str, width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches with the sets of their texts; a slice is short, so the lists stay small."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            piece = batch.slice(start, 256)
            yield piece, [shingle_hashes(t.as_py(), width) for t in piece.column(column)]


# --- the order and the boundary --------------------------------------------------------


def sampled_sets(documents: DataFrame, width: int, text_col: str) -> tuple[DataFrame, int]:
    """``(hashes)`` of about ``SAMPLE`` different texts, and which share of the table they stand for."""
    small_batches(documents.sparkSession)
    part = max(1, documents.count() // SAMPLE)
    text = F.col(text_col)
    chosen = documents.select(text.alias("text")).where(F.pmod(F.xxhash64(text), F.lit(part)) == 0).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.forget()
        for _, sets in _sets(batches, "text", width):
            yield pa.RecordBatch.from_arrays([_lists(sets)], names=["hashes"])

    return cut(chosen.mapInArrow(run, "hashes array<bigint>"), "join-sample"), part


def common_shingles(sample: DataFrame) -> np.ndarray:
    """Hashes that are in several sets of the sample, rarest first."""
    often = sample.select(F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("often"))
    top = often.where("often > 2").orderBy(F.desc("often"), "hash").limit(COMMON).toArrow()
    return top["hash"].to_numpy()[::-1].astype(np.int64).view(np.uint64)


def size_class(n: int) -> int:
    """Classes of sizes in steps of a tenth."""
    return int(math.log(max(n, 1)) / math.log(1.1))


def choose_boundary(sample: DataFrame, order: Order, part: int) -> int:
    """The largest size of light sets, at which the expected cost is least.

    A set costs a row for each subset or list, and ``MEETING`` rows for each set that it is
    expected to meet there: as many as in the sample, times the number of sets that a sampled one stands for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                made = []
                for value in batch.slice(start, 256).column("hashes"):
                    hashes = np.array(value.as_py(), np.int64).view(np.uint64)
                    n = len(hashes)
                    if 4 <= n <= LIGHTEST:
                        made.append((0, size_class(n), subset_marks(hashes, order)))
                    if n >= 4:
                        made.append((1, size_class(n), list_marks(hashes, order)))
                kinds, classes = (pa.array([m[k] for m in made], pa.int32()) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([kinds, classes, _lists([m[2] for m in made])], names=["kind", "class", "marks"])

    marked = sample.mapInArrow(run, "kind int, class int, marks array<bigint>")
    rows = cut(marked.select("kind", "class", F.explode("marks").alias("mark")), "join-costs")
    met = rows.groupBy("kind", "mark").agg(F.count(F.lit(1)).alias("sets"))
    costs = rows.join(met, ["kind", "mark"]).groupBy("class", "kind").agg(
        (F.count(F.lit(1)) + F.lit(MEETING * part) * F.sum(F.col("sets") - 1)).alias("cost")
    )
    cost = {(r["class"], r["kind"]): r["cost"] for r in costs.collect()}  # two rows for each tenth of size
    classes = sorted({c for c, _ in cost})
    if not classes:
        return 0
    best, boundary = math.inf, 0
    for last in range(min(classes) - 1, max(classes) + 1):
        light = sum(cost.get((c, 0), math.inf) for c in classes if c <= last)
        # Light sets down to 0.8 times the boundary are in the lists too: two classes.
        heavy = sum(cost.get((c, 1), 0) for c in classes if c > last - 2)
        if light + heavy < best:
            best, boundary = light + heavy, math.ceil(1.1 ** (last + 1)) - 1
    return boundary


# --- bit filters -----------------------------------------------------------------------


def bit_filter(values: DataFrame, column: str) -> np.ndarray:
    """A filter of a fixed size with the bits of all values, which are hashes, set: what is in ``values``
    passes, and little else as long as there are fewer values than bits."""
    cells = values.select(F.shiftrightunsigned(column, 64 - FILTER_BITS).alias("cell"))
    words = cells.selectExpr("cast(shiftright(cell, 6) as int) as word", "shiftleft(1L, cast(cell % 64 as int)) as bit")
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy()
    return bits.view(np.uint64)


def passes(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether these values pass."""
    cell = values.astype(np.int64).view(np.uint64) >> np.uint64(64 - FILTER_BITS)
    return (bits[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63))) & np.uint64(1) == 1


# --- the join --------------------------------------------------------------------------


def read_sets(documents: DataFrame, order: Order, boundary: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """``(id_col, node, n, b0..b3, wide, text_key, marks)`` of every row. ``node`` is a 128-bit digest of the set, null if it is empty;
    ``text_key`` finds the text again."""
    fields = T.StructType.fromDDL("node binary, n int, b0 long, b1 long, b2 long, b3 long, wide binary, text_key long, marks array<bigint>")
    schema = T.StructType([T.StructField(id_col, documents.schema[id_col].dataType), *fields.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.forget()
        for piece, sets in (x for batch in batches for x in _sets([batch], "text", width)):
            bits = np.array([parity(s) for s in sets], np.int64).reshape(-1, 4)
            nodes = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            columns = [
                piece.column("id"),
                pa.array(nodes, pa.binary()),
                pa.array(map(len, sets), pa.int32()),
                *[pa.array(bits[:, k]) for k in range(4)],
                pa.array(map(wide_parity, sets), pa.binary()),
                piece.column("text_key"),
                _lists([marks(s, order, boundary) for s in sets]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    text = F.col(text_col)
    rows = documents.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    return rows.mapInArrow(run, schema)


class Joined:
    """Distinct sets of a table, and how to compare them."""

    def __init__(self, documents: DataFrame, sets: DataFrame, width: int, text_col: str):
        """``sets``: ``(id, node, n, b0..b3, wide, text_key)``, one row for each different set."""
        self.documents, self.sets, self.width, self.text_col = documents, sets, width, text_col

    def described(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that sizes and parities do not rule out."""
        facts = ("n", *BITS, "wide")
        for side in ("a", "b"):
            pairs = pairs.join(self.sets.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in facts]), side)
        sides = ["a", "b", "n_a", "n_b", "wide_a", "wide_b"]
        schema = T.StructType.fromDDL("a long, b long")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b, n, m, one, other = (batch.column(c) for c in sides)
                rows = zip(n.to_pylist(), m.to_pylist(), one, other, strict=True)
                hit = [9 * bits_apart(x.as_py(), y.as_py()) <= n + m for n, m, x, y in rows]
                yield pa.RecordBatch.from_arrays([a, b], names=schema.names).filter(pa.array(hit, pa.bool_()))

        return pairs.where(may_link("_a", "_b")).select(*sides).mapInArrow(run, schema)

    def hashes_of(self, ids: DataFrame) -> DataFrame:
        """``(id, hashes)`` of the sets with these ids, from the texts of their documents."""
        wanted = cut(self.sets.join(ids, "id", "left_semi").select("id", "node", "text_key"), "join-wanted")
        bits, width = bit_filter(wanted, "text_key"), self.width
        schema = T.StructType.fromDDL("node binary, hashes array<bigint>")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bpe.forget()
            done: set[int] = set()  # copies of a text are read once in a task
            for batch in batches:
                hit = passes(bits, batch.column("text_key").to_numpy())
                keys = batch.column("text_key").to_pylist()
                rows = []
                for i in np.flatnonzero(hit).tolist():
                    if keys[i] not in done:
                        done.add(keys[i])
                        rows.append(i)
                some = pa.RecordBatch.from_arrays([batch.column("text").take(pa.array(rows, pa.int64()))], names=["text"])
                for _, sets in _sets([some], "text", width):
                    nodes = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                    yield pa.RecordBatch.from_arrays([nodes, _lists(sets)], names=schema.names)

        text = F.col(self.text_col)
        rows = self.documents.select(text.alias("text"), F.xxhash64(text).alias("text_key"))
        read = rows.mapInArrow(run, schema).join(wanted.select("id", "node"), "node").dropDuplicates(["node"])
        return cut(read.select("id", "hashes"), "join-sets")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The linked ones of distinct pairs (a, b). Pairs with the same ``a`` are compared where its set
        is, in several places if they are many."""
        pairs = cut(self.described(pairs), "join-pairs")
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        sets = self.hashes_of(ids)
        often = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > MEMBERS_PER_TASK)
        places = F.coalesce(F.ceil(F.col("times") / MEMBERS_PER_TASK), F.lit(1))
        dealt = pairs.join(small(cut(often, "join-often")), "a", "left").select(
            "a", "b", F.pmod(F.xxhash64("b"), places).cast("int").alias("place")
        )
        own = dealt.select("a", "place").distinct().join(sets.withColumnRenamed("id", "a"), "a")
        other = dealt.join(sets.withColumnRenamed("id", "b"), "b")
        rows = own.select("a", "place", F.lit(None).cast("long").alias("b"), "hashes").unionByName(
            other.select("a", "place", "b", "hashes")
        )
        schema = T.StructType.fromDDL("a long, b long")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            leader, mine = None, None
            for batch in batches:
                found = []
                hashes = batch.column("hashes")
                for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                    values = hashes[i].values.to_numpy().view(np.uint64)
                    if b is None:
                        leader, mine = a, values
                    elif leader == a and alike(mine, values):
                        found.append((a, b))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=schema.names
                )

        sides = rows.repartition("a", "place").sortWithinPartitions("a", "place", "b")
        links = cut(sides.mapInArrow(run, schema), "join-links")
        discard(sets)
        return links


def may_link(a: str, b: str):
    """Whether two sets can have a similarity of 0.8: by their sizes, and by the bits of their parities."""
    n, m = F.col(f"n{a}"), F.col(f"n{b}")
    apart = sum(F.bit_count(F.col(f"{c}{a}").bitwiseXOR(F.col(f"{c}{b}"))) for c in BITS)
    return (n * 5 >= m * 4) & (m * 5 >= n * 4) & (apart * 9 <= n + m)


def may_meet(a: str, b: str):
    """Whether two sets that can link may have their bucket's shingle as the first one they share: what comes before it is
    in one of them only, and so is at least what one has more than the other after it. Subsets have no place."""
    i, j, n, m = F.col(f"at{a}"), F.col(f"at{b}"), F.col(f"n{a}"), F.col(f"n{b}")
    return (i < 0) | (j < 0) | ((i + j + F.abs((n - i) - (m - j))) * 9 <= n + m)


def _pair(one: str, other: str) -> list:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def _placed(links: DataFrame) -> DataFrame:
    """``(id, part)`` of every linked set: the smallest id reachable."""
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    parts = components(ends.withColumn("label", F.col("node")), links)
    return cut(parts.select(F.col("node").alias("id"), F.col("label").alias("part")), "join-parts")


def _several(members: DataFrame, parts: DataFrame) -> DataFrame:
    """``members`` with their ``part``, of the buckets whose members are still in several parts."""
    placed = members.join(parts, "id", "left").withColumn("part", F.coalesce("part", "id"))
    placed = cut(placed.select(*members.columns, "part"), "join-members")
    apart = placed.groupBy("mark").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high")
    open_ = cut(placed.join(apart.select("mark"), "mark", "left_semi"), "join-members")
    discard(placed)
    return open_


def connected_sets(joined: Joined, marked: DataFrame, boundary: int) -> DataFrame:
    """``(id, part)`` of every set that has a link; ``part`` is the smallest id reachable over links.

    ``marked`` is ``(id, n, b0..b3, marks)`` of every different set, ``boundary`` that of :func:`marks`. Two sets that link are
    compared in the bucket of the first shingle they share, or of a subset, unless they are in one part by then.
    """
    facts = ["n", *BITS]
    spread = marked.select("id", F.explode("marks").alias("mark"))
    met = spread.groupBy("mark").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    bits = bit_filter(cut(met.where("low <> high").select("mark"), "join-buckets"), "mark")

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("marks")
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            found = lists.flatten().to_numpy(zero_copy_only=False)
            hit = passes(bits, found)
            at = places(batch.column("n").to_numpy(), lengths, boundary)[hit].astype(np.int32)
            own = batch.select(["id", *facts]).take(pa.array(np.repeat(np.arange(batch.num_rows), lengths)[hit]))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(at), pa.array(found[hit])], names=["id", *facts, "at", "mark"])

    # Sizes, parities and places travel with the members, so what they rule out is never paired.
    schema = "id long, n int, b0 long, b1 long, b2 long, b3 long, at int, mark long"
    likely = cut(marked.select("id", *facts, "marks").mapInArrow(shared, schema), "join-likely")
    facts = [*facts, "at"]
    ends = [f(F.struct("id", *facts)).alias(side) for f, side in ((F.min, "low"), (F.max, "high"))]
    met = cut(likely.groupBy("mark").agg(*ends, F.count(F.lit(1)).alias("sets")), "join-buckets")

    def side(row: str, name: str, *more: str) -> list:
        return [F.col(f"{row}{c}").alias(f"{c}_{name}") for c in ("id", *facts, *more)]

    larger = met.where("sets > 2").select("mark", *side("low.", "a"))
    members = cut(likely.join(shuffled(larger), "mark").select("mark", *side("", "b"), *[f"{c}_a" for c in ("id", *facts)]), "join-members")
    discard(likely)
    pairs = met.where("sets = 2").select(*side("low.", "a"), *side("high.", "b"))
    pairs = pairs.unionByName(members.where("id_b <> id_a").drop("mark")).where(may_link("_a", "_b") & may_meet("_a", "_b"))
    pairs = pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).where("a <> b").distinct()
    links = joined.verify(pairs)
    members = members.select("mark", *[F.col(f"{c}_b").alias(c) for c in ("id", *facts)])
    parts = _placed(links)
    open_ = _several(members, parts)
    if open_.isEmpty():
        return parts

    # A few more leaders for each bucket: most sets of a group are alike to one of them.
    orders = [F.xxhash64("id", F.lit(k)) for k in range(LEADERS)]
    row = F.struct("id", *facts, "part")
    leaders = open_.groupBy("mark").agg(
        F.min("id").alias("low"), F.array_distinct(F.array(*[F.max_by(row, o) for o in orders])).alias("leaders")
    )
    led = cut(open_.join(leaders, "mark"), "join-members")
    pairs = led.where("id <> low").select(*side("", "x", "part"), F.explode("leaders").alias("leader"))
    pairs = pairs.select("*", *side("leader.", "y", "part")).where("part_x <> part_y")
    pairs = pairs.where(may_link("_x", "_y") & may_meet("_x", "_y")).select(*_pair("id_x", "id_y"))
    links = cut(links.unionByName(joined.verify(pairs.distinct())), "join-links")
    parts = _placed(links)
    # A leader has been compared with all of its bucket: the others are left.
    left = led.where("id <> low").where(~F.exists("leaders", lambda x: x["id"] == F.col("id")))
    open_ = _several(left.select("mark", "id", *facts), parts)
    if open_.isEmpty():
        return parts

    # What is left: the sets outside the largest part of a bucket against all others of it.
    sizes = open_.groupBy("mark", "part").agg(F.count(F.lit(1)).alias("sets"))
    largest = sizes.groupBy("mark").agg(F.max_by("part", F.struct("sets", "part")).alias("largest"))
    # Two sets that share a passage meet in many buckets. Where the last few buckets before have one in
    # common, they have met there already: in subsets first, then in the order of shingles, so that the first they share stays.
    before = Window.partitionBy("id").orderBy("at", "mark").rowsBetween(-PRIOR, -1)
    whole = open_.join(largest, "mark").withColumn("prior", F.collect_list("mark").over(before))
    whole = cut(whole, "join-members")
    few = whole.where("part <> largest").select("mark", *side("", "x", "part", "prior"))
    many = whole.select("mark", *side("", "y", "part", "prior", "largest"))
    once = (F.col("part_y") == F.col("largest_y")) | (F.col("id_x") < F.col("id_y"))
    fresh = ~F.arrays_overlap("prior_x", "prior_y")
    on = (few["mark"] == many["mark"]) & (F.col("part_x") != F.col("part_y")) & once
    on = on & may_link("_x", "_y") & may_meet("_x", "_y") & fresh
    rest = few.join(many, on).select(*_pair("id_x", "id_y")).distinct()
    return _placed(cut(links.unionByName(joined.verify(rest)), "join-links"))


def ngram_components(
    documents: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id_col, n_shingles, component_id)`` for every row of ``documents``.

    A row's set are the distinct shingles of ``width`` words of its text (A-Z lower-cased, words parted by ASCII
    white space); rows link at a Jaccard similarity of 0.8 or more. ``component_id`` is the smallest id reachable over
    links, the row's own included.

    * Fewer words than ``width`` make one shingle. Null texts and texts without a word have no
      shingle and link with nothing: their component is their own id.
    * Equal sets link, so repeated rows do; they stay repeated. Null ids are labelled by the ids they
      reach, null if there are none. Other columns are ignored; an empty table gives an empty result.
    * Shingles are compared by 64-bit hashes and equal sets by 128-bit digests.
    """
    sample, part = sampled_sets(documents, width, text_col)
    order = Order(common_shingles(sample))
    boundary = choose_boundary(sample, order, part)
    read = cut(read_sets(documents, order, boundary, width, id_col, text_col), "join-rows")
    classes = distinct_sets(read, id_col)
    rows = cut(read.select(id_col, "node", "n"), "join-thin")
    discard(read)
    joined = Joined(documents, classes.drop("marks", "smallest"), width, text_col)
    parts = connected_sets(joined, classes.where("n >= 4").select("id", "n", *BITS, "marks"), boundary)
    return label_rows(rows, classes, parts, id_col)


def distinct_sets(rows: DataFrame, id_col: str) -> DataFrame:
    """``(id, node, n, b0..b3, wide, text_key, marks, smallest)``: one row for each different set, numbered by ``id``;
    ``smallest`` is the smallest id of its rows."""
    kept = ["n", *BITS, "wide", "text_key", "marks"]
    numbered = rows.where("node is not null").withColumn("id", F.monotonically_increasing_id())
    one = numbered.groupBy("node").agg(
        F.min("id").alias("id"), F.min(id_col).alias("smallest"), *[F.first(c).alias(c) for c in kept]
    )
    return cut(one.select("id", "node", *kept, "smallest"), "join-classes")


def label_rows(rows: DataFrame, classes: DataFrame, parts: DataFrame, id_col: str) -> DataFrame:
    """``(id_col, n_shingles, component_id)`` of every row."""
    linked = classes.select("id", "node", "smallest").join(parts, "id", "left")
    linked = linked.select("node", "smallest", F.coalesce("part", "id").alias("part"))
    names = linked.groupBy("part").agg(F.min("smallest").alias("component_id"))
    labels = lookup_join(linked.select("node", "part"), names, "part", "inner").select("node", "component_id")
    thin = rows.select(id_col, "node", F.col("n").cast("long").alias("n_shingles"))
    label = F.when(F.col("node").isNull(), F.col(id_col)).otherwise(F.col("component_id"))
    return lookup_join(thin, labels, "node", "left").select(id_col, "n_shingles", label.alias("component_id"))
