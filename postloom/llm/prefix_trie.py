"""Conversation prefix trie by truncation peeling.

Every distinct beginning of a conversation is a node. A beginning is known by a 128-bit key: the
xor of one hash per (place, role, text), so the keys of all beginnings of a conversation are a
running xor over its turns, and a turn taken off the end is a hash taken out of the key.

1. The deepest turns are truncated first: turns of one conversation that the same conversations
   share form a run, and a run's turns fall off together. Runs are found by grouping the nodes
   by (smallest member, number of members), since nested beginnings with as many members have the
   same members. A tail that only one conversation has is one run, however long.
2. Then come rounds of peeling. Runs under which nothing is left fall off: what they count is
   regrouped by the node on which they stood, merged there with the conversations that end at
   it, and a node that has heard of all its children falls off in the next round. Each run is
   counted once, when it falls off.

There are as many rounds as branchings on the longest way from the root to a leaf, which is not the
number of turns.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.operators.ordered import lookup_join
from postloom.session import cut

WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_PART = 500_000
IDS_PER_CHUNK = 1 << 16
SPLICE, HEADS = 20, 4  # the numbers of the query's rule: neighbours of a base, kinds of heads

NODES = T.StructType(
    [T.StructField(n, T.LongType()) for n in "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens".split()]
    + [T.StructField("ends_sha256", T.StringType())]
)


def _parts(rows: int) -> int:
    return max(1, math.ceil(rows / ROWS_PER_PART))


def running(df: DataFrame, key: str, order: list[str], sums: dict[str, tuple[str, Column]], parts: int) -> DataFrame:
    """``df`` with running totals inside ``key`` in the given order, the own row included.

    ``sums`` maps a new column to ``("sum" | "xor", value)``. Rows are dealt by ranges of (key, order),
    so a long key is spread over several tasks; one row for each range a key reaches into
    carries totals from range to range.
    """
    how = {"sum": F.sum, "xor": F.bit_xor}
    ranged = df.repartitionByRange(max(parts, 1), key, *order).withColumn("__part", F.spark_partition_id())
    ranged = cut(ranged.withColumns({f"__{n}": v for n, (_, v) in sums.items()}), "trie-ranges")
    inside = Window.partitionBy(key, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = ranged.groupBy(key, "__part").agg(*[how[k](f"__{n}").alias(f"__{n}") for n, (k, _) in sums.items()])
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        key, "__part", *[F.coalesce(how[k](f"__{n}").over(before), F.lit(0)).alias(f"__before_{n}") for n, (k, _) in sums.items()]
    )
    local = ranged.withColumns({n: how[k](f"__{n}").over(inside) for n, (k, _) in sums.items()})
    whole = local.join(carried, [key, "__part"])
    joined = {
        n: (F.col(n) + F.col(f"__before_{n}") if k == "sum" else F.col(n).bitwiseXOR(F.col(f"__before_{n}"))).cast("long")
        for n, (k, _) in sums.items()
    }
    return whole.withColumns(joined).select(*df.columns, *sums)


def thin_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, g1, g2, words)``: every turn with a digest of its role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.xxhash64(role, text).alias("g1"),
        F.xxhash64(F.lit(1), role, text).alias("g2"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )


def number_turns(turns: DataFrame, parts: int) -> DataFrame:
    """``turns`` with ``pos``, from 1, in the order of ``turn``, a null first, then of the digest."""
    # Nulls come first in Spark's ascending order, in windows and in ranges alike.
    return running(turns, "conv_id", ["turn", "g1", "g2"], {"pos": ("sum", F.lit(1).cast("long"))}, parts)


def splice_heads(turns: DataFrame, splice: int = SPLICE, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt by the query's rule: ``(conv_id, pos, g1, g2, words)`` of the turns, and
    ``(conv_id, n)`` of all conversations, ``n`` being the number of rebuilt turns.

    A conversation takes the first ``h`` turns of conversation ``c - c % splice`` and then its own after its first
    ``h``; ``h`` is the CRC-32 of its decimal id modulo ``heads``.
    """
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("own"))
    c = F.col("conv_id")
    convs = sizes.select(
        "conv_id", "own", (F.crc32(c.cast("string")) % heads).alias("h"), (c - F.pmod(c, F.lit(splice))).alias("base")
    )
    # Each base has fewer than `splice` followers and lends fewer than `heads` turns to each.
    lent = turns.where(F.col("pos") < heads).withColumnRenamed("conv_id", "base")
    taken = convs.select("conv_id", "h", "base").join(lent, "base").where(F.col("pos") <= F.col("h"))
    taken = taken.select("conv_id", "pos", "g1", "g2", "words")
    has = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("base_size"))
    convs = convs.join(has, "base", "left").select(
        "conv_id", "own", "h", F.least("h", F.coalesce("base_size", F.lit(0))).alias("lent")
    )
    convs = cut(convs, "trie-conversations")
    # A conversation may own any number of the rows: lookup_join spreads such a key.
    own = lookup_join(turns, convs.select("conv_id", "h", "lent"), "conv_id", "inner").where(F.col("pos") > F.col("h"))
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), "g1", "g2", "words")
    sizes = convs.select("conv_id", (F.col("lent") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("n"))
    return taken.unionByName(own), sizes


def prefixes(turns: DataFrame, parts: int) -> DataFrame:
    """``(conv_id, depth, key, parent, total, before)`` of every beginning with at least one turn;
    ``total`` is the number of words of all its turns, ``before`` without the last one."""
    one = F.xxhash64("pos", "g1", "g2")
    two = F.xxhash64("g2", "pos", "g1")
    hashed = turns.select("conv_id", "pos", "words", one.alias("k1"), two.alias("k2"))
    sums = {"x1": ("xor", F.col("k1")), "x2": ("xor", F.col("k2")), "total": ("sum", F.col("words"))}
    run = running(hashed, "conv_id", ["pos"], sums, parts)
    return run.select(
        "conv_id",
        F.col("pos").alias("depth"),
        F.struct(F.col("x1").alias("a"), F.col("x2").alias("b")).alias("key"),
        F.struct(F.col("x1").bitwiseXOR(F.col("k1")).alias("a"), F.col("x2").bitwiseXOR(F.col("k2")).alias("b")).alias("parent"),
        "total",
        (F.col("total") - F.col("words")).alias("before"),
    )


def digest_ids(ends: DataFrame, parts: int) -> DataFrame:
    """``(conv_id, depth, ends_sha256)`` of ``(conv_id, depth, member)``: SHA-256 of the members in
    ascending order, joined by commas.

    Members are sorted over ranges and packed into chunks of a bounded size; then the chunks of a
    node are hashed one after the other, so no list of members is ever held.
    """
    packed = T.StructType.fromDDL("conv_id long, depth long, first long, ids binary")
    hashed = T.StructType.fromDDL("conv_id long, depth long, ends_sha256 string")

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

    def batched(made, schema: T.StructType, size: int) -> Iterator[pa.RecordBatch]:
        some = []
        for row in made:
            some.append(row)
            if len(some) == size:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in some])
                some = []
        if some:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in some])

    def pack(batches):
        def chunks():
            node, ids = None, []
            for conv, depth, member in rows(batches):
                if node != (conv, depth) or len(ids) == IDS_PER_CHUNK:
                    if ids:
                        yield (*node, ids[0], ",".join(map(str, ids)).encode())
                    node, ids = (conv, depth), []
                ids.append(member)
            if ids:
                yield (*node, ids[0], ",".join(map(str, ids)).encode())

        yield from batched(chunks(), packed, 256)

    def digest(batches):
        def digests():
            node, sha = None, None
            for conv, depth, _, ids in rows(batches):
                if node == (conv, depth):
                    sha.update(b"," + ids)
                    continue
                if node is not None:
                    yield (*node, sha.hexdigest())
                node, sha = (conv, depth), hashlib.sha256(ids)
            if node is not None:
                yield (*node, sha.hexdigest())

        yield from batched(digests(), hashed, 4096)

    order = ["conv_id", "depth", "member"]
    ranged = ends.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    chunks = ranged.mapInArrow(pack, packed).repartition(max(parts, 1), "conv_id", "depth")
    return chunks.sortWithinPartitions("conv_id", "depth", "first").mapInArrow(digest, hashed)


def peel(runs: DataFrame) -> DataFrame:
    """``(run, n_children, leaves, saved)`` of every run: the leaves under its top, and the tokens
    saved in it and below it.

    ``runs`` has ``run``, ``up`` (the run on which it stands, null: none) and ``own`` (tokens that its own turns
    save). A round takes off the runs that wait for no child and adds up what they count, once for
    each run on which they stood.
    """
    long = "long"
    children = runs.where("up is not null").groupBy(F.col("up").alias("run")).agg(F.count(F.lit(1)).alias("n_children"))
    waiting = runs.join(children, "run", "left").select(
        "run",
        "up",
        F.coalesce("n_children", F.lit(0)).cast(long).alias("n_children"),
        F.coalesce("n_children", F.lit(0)).cast(long).alias("missing"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast(long).alias("leaves"),
        F.col("own").cast(long).alias("saved"),
    )
    waiting = cut(waiting, "trie-waiting")
    done = []
    while True:
        fallen, waiting = waiting.where("missing = 0"), waiting.where("missing > 0")
        done.append(fallen.select("run", "n_children", "leaves", "saved"))
        if waiting.isEmpty():
            return reduce(DataFrame.unionByName, done)
        told = fallen.groupBy(F.col("up").alias("run")).agg(
            F.count(F.lit(1)).alias("told"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
        )
        zero = F.lit(0)
        heard = waiting.join(told, "run", "left").select(
            "run",
            "up",
            "n_children",
            (F.col("missing") - F.coalesce("told", zero)).alias("missing"),
            (F.col("leaves") + F.coalesce("more_leaves", zero)).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", zero)).alias("saved"),
        )
        waiting = cut(heard, "trie-waiting")


def trie(turns: DataFrame, sizes: DataFrame, parts: int = 1) -> DataFrame:
    """One row per node of the trie of conversations; columns as in :func:`prefix_trie`.

    ``turns`` is ``(conv_id, pos, g1, g2, words)``, ``pos`` being 1, 2, ... in each conversation; ``sizes`` is ``(conv_id, n)``
    of every conversation, those without a turn included.
    """
    spark = turns.sparkSession
    total, smallest = sizes.agg(F.count(F.lit(1)), F.min("conv_id")).first()
    if not total:
        return spark.createDataFrame([], NODES)

    def whole(value):
        return F.lit(value).cast("long")

    begins = cut(prefixes(turns, parts), "trie-prefixes")
    nodes = begins.groupBy("key", "parent", "depth").agg(
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.max("total").alias("total"),
        F.max("before").alias("before"),
    )
    nodes = nodes.withColumn("run", F.struct("conv_id", "n_convs"))
    top_run = F.struct(whole(smallest).alias("conv_id"), whole(total).alias("n_convs"))
    root = spark.range(1).select(
        *[F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in ("key", "parent")],
        *[whole(v).alias(c) for c, v in (("depth", 0), ("conv_id", smallest), ("n_convs", total), ("total", 0), ("before", 0))],
        top_run.alias("run"),
    )
    nodes = cut(nodes.unionByName(root), "trie-nodes")
    runs = nodes.groupBy("run").agg(
        F.min_by("parent", "depth").alias("parent"),
        F.min("depth").alias("top"),
        F.max("depth").alias("bottom"),
        F.min("before").alias("before"),
        F.max("total").alias("total"),
    )
    # The first node of a run stands on the last node of another one, or on the root.
    above = nodes.where("depth > 0").select(F.col("key").alias("parent"), F.col("run").alias("up"))
    deep = lookup_join(runs.where("top > 1"), above, "parent", "left").drop("parent")
    flat = runs.where("top <= 1").drop("parent").withColumn("up", F.when(F.col("top") == 1, top_run))
    own = (F.col("run.n_convs") - 1) * (F.col("total") - F.col("before"))
    runs = cut(flat.unionByName(deep).withColumn("own", own).drop("total"), "trie-runs")
    counted = peel(runs.select("run", "up", "own"))
    runs = cut(runs.select("run", "top", "bottom", F.col("before").alias("run_before"), "up").join(counted, "run"), "trie-counted")

    last = begins.join(sizes.withColumnRenamed("n", "depth"), ["conv_id", "depth"])
    last = cut(last.select(F.col("conv_id").alias("member"), "key"), "trie-ends")
    ended = last.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("member").alias("only"))
    ended = ended.join(nodes.select("key", "conv_id", "depth"), "key")
    alone = F.sha2(F.col("only").cast("string").cast("binary"), 256).alias("ends_sha256")
    single = ended.where("m = 1").select("conv_id", "depth", alone)
    # Only beginnings at which several conversations end need sorting.
    many = lookup_join(last, ended.where("m > 1").select("key", "conv_id", "depth"), "key", "inner")
    turnless = sizes.where("n = 0").select(
        whole(smallest).alias("conv_id"), whole(0).alias("depth"), F.col("conv_id").alias("member")
    )
    lists = digest_ids(many.select("conv_id", "depth", "member").unionByName(turnless), parts)
    digests = single.unionByName(lists)

    placed = lookup_join(nodes.select("run", "depth", "before"), runs, "run", "inner")
    n = F.col("run.n_convs")
    made = placed.select(
        "run.conv_id",
        "depth",
        F.when(F.col("depth") > F.col("top"), F.col("run.conv_id")).otherwise(F.col("up.conv_id")).alias("parent_conv_id"),
        n.alias("n_convs"),
        F.when(F.col("depth") == F.col("bottom"), F.col("n_children")).otherwise(whole(1)).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") - (n - 1) * (F.col("before") - F.col("run_before"))).alias("saved_tokens"),
    )
    nothing = hashlib.sha256(b"").hexdigest()
    out = made.join(digests, ["conv_id", "depth"], "left")
    return out.select(*made.columns, F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, splice: bool = False) -> DataFrame:
    """The prefix trie of ``conversations`` (``conv_id, turn, role, text``): one row per distinct
    beginning (role and text of its turns), from the beginning without a turn on.

    ``conv_id`` is the smallest conversation that starts with it, ``depth`` its number of turns, ``n_convs`` how many
    start with it, ``n_leaves`` the childless nodes in its subtree, ``saved_tokens`` what a cache of
    beginnings saves in the subtree, ``ends_sha256`` a digest of the conversations that end at it. With
    ``splice`` conversations are first rebuilt (:func:`splice_heads`).

    * Turns are ordered by ``turn``, null first; turns of one number by the digest of role and
      text, so repeated rows are two turns. A null role or text is an empty one. Rows without a
      conv_id take no part. Other columns are ignored. An empty table has no node, not even a root.
    * Conversations and copies of any number and length are spread: positions and keys are
      totals carried from range to range, nodes and rounds are aggregates that are reduced before they are
      shuffled, and members are hashed in chunks.
    """
    thin = cut(thin_turns(conversations), "trie-turns")
    parts = _parts(thin.count())
    turns = cut(number_turns(thin, parts), "trie-numbered")
    if splice:
        rebuilt, sizes = splice_heads(turns)
        turns = cut(rebuilt, "trie-rebuilt")
    else:
        sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    return trie(turns, cut(sizes, "trie-sizes"), parts)
