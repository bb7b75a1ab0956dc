"""Tiered consolidation: fold a batch of postings into the store.

Reading the rules one row at a time: a batch row takes the place of the stored posting that
holds one of its keys (URL, then requisition, then identity, then text), or is appended; the
replaced row gives up its keys. Stated over the whole table instead:

* A key is held by the last earlier row that carries it, if that row has not been replaced.
* So a row has at most four possible predecessors, one per tier: the previous row with the
  same key. It replaces the first of them that no earlier row has replaced.
* A predecessor has at most four possible successors, and the earliest that picks it wins.

Finding predecessors is a lag per key. Choosing is a matching on rows with at most four links
each way, solved for all rows at once; chains of replacements are then followed by pointer
doubling. No step gathers a key, a component or a posting's history into one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions.text import (
    fingerprint,
    has_fingerprintable,
    has_usable_title,
    norm_key,
)
from postloom.functions.urls import with_canonical_url
from postloom.operators.ordered import (
    ROWS_PER_BLOCK,
    lag_in_key,
    lookup_join,
    ordered_union,
    shuffled,
    small,
    spread,
)
from postloom.session import cut

TIERS = ["k1", "k2", "k3", "k4"]
KEY = "__key"
# A batch with at most this many keys (some 100 bytes each on the driver) is broadcast to the store.
BROADCAST_LINKS = 500_000
# Likewise for the rows that take part in a replacement (some hundred bytes each).
BROADCAST_FATES = 100_000


def _short(digest: Column) -> Column:
    """The first 128 bits of a hex digest: short to shuffle, too long to collide by chance."""
    return F.unhex(F.substring(digest, 1, 32))


def _digest(text: Column) -> Column:
    return _short(F.sha2(text, 256))


def tier_keys(df: DataFrame) -> DataFrame:
    """``(seq, k1..k4)``: URL, requisition, identity and text key; null where not eligible."""
    read = df.select("seq", "canonicalUrl", "source", "requisitionId", "company", "title", "location", "descriptionText")
    keyed = with_canonical_url(spread(read), "canonicalUrl", "__url")
    requisition = F.when(
        F.col("requisitionId") != "", F.concat_ws("::", "source", "requisitionId")
    )
    identity = F.when(
        has_usable_title(F.col("title")), norm_key(F.col("company"), F.col("title"), F.col("location"))
    )
    text = F.when(
        has_fingerprintable(F.col("descriptionText")), fingerprint(F.col("descriptionText"))
    )
    return keyed.select(
        "seq",
        _digest(F.col("__url")).alias("k1"),
        _digest(requisition).alias("k2"),
        _digest(identity).alias("k3"),
        _short(text).alias("k4"),
    )


def tier_links(keys: DataFrame) -> DataFrame:
    """One row per (seq, tier, key) that is present."""
    pairs = F.array(
        *[F.struct(F.lit(i).alias("tier"), F.col(k).alias("key")) for i, k in enumerate(TIERS, 1)]
    )
    return (
        keys.select("seq", F.explode(pairs).alias("p"))
        .select("seq", F.col("p.tier").alias("tier"), F.col("p.key").alias("key"))
        .where(F.col("key").isNotNull())
    )


def _candidates(
    store_keys: DataFrame | None, batch_keys: DataFrame, blocks: int | None
) -> DataFrame:
    """``(seq, prev)`` for batch rows: the distinct previous holders, in tier order."""
    links = tier_links(batch_keys)
    rows = links.count()
    if blocks is None:
        blocks = max(1, math.ceil(rows / ROWS_PER_BLOCK))
    lagged = lag_in_key(links, ["tier", "key"], "seq", "seq", "prev", blocks)
    if store_keys is not None:
        # Only the last stored row of a key can hold it; only the first batch row asks for it.
        stored = tier_links(store_keys)
        if rows <= BROADCAST_LINKS:
            # A small batch: keep the stored keys it mentions before anything is shuffled.
            asked = links.select("tier", "key").distinct()
            stored = stored.join(F.broadcast(asked), ["tier", "key"], "left_semi")
        last_stored = stored.groupBy("tier", "key").agg(F.max("seq").alias("stored"))
        heads = lagged.where(F.col("prev").isNull()).drop("prev")
        from_store = heads.join(shuffled(last_stored), ["tier", "key"]).select(
            "seq", "tier", F.col("stored").alias("prev")
        )
        lagged = lagged.where(F.col("prev").isNotNull()).select("seq", "tier", "prev")
        lagged = lagged.unionByName(from_store)
    return (
        lagged.where(F.col("prev").isNotNull())
        .groupBy("seq")
        .agg(F.array_sort(F.collect_list(F.struct("tier", "prev"))).alias("c"))
        .select("seq", F.array_distinct(F.transform("c", lambda x: x["prev"])).alias("prev"))
    )


def _with_rivals(candidates: DataFrame) -> DataFrame:
    """``(seq, prefs)``: each candidate with the earlier rows that could also pick it."""
    edges = candidates.select("seq", F.posexplode("prev").alias("pos", "prev"))
    # At most four rows ask for the same predecessor, one per tier.
    askers = F.collect_list("seq").over(Window.partitionBy("prev"))
    return (
        edges.withColumn("rivals", F.filter(askers, lambda s: s < F.col("seq")))
        .groupBy("seq")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "prev", "rivals"))).alias("prefs"))
    )


def _settle_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Settle the rows of one sequence range whose rivals are all settled in that range."""
    choice: dict[int, int] = {}
    for pdf in batches:
        picked = []
        for seq, prefs in zip(pdf["seq"], pdf["prefs"]):
            pick = -1
            for pref in prefs:
                states = [choice.get(rival) for rival in pref["rivals"]]
                if pref["prev"] in states:
                    continue
                pick = None if None in states else pref["prev"]
                break
            picked.append(pick)
            if pick is not None:
                choice[seq] = pick
        yield pd.DataFrame({"seq": pdf["seq"], "choice": pd.array(picked, dtype="Int64")})


def _apply_settled(pending: DataFrame, settled: DataFrame) -> DataFrame:
    """Drop settled rivals, and the candidates they took."""
    exploded = pending.select("seq", F.explode("prefs").alias("p")).select(
        "seq", "p.pos", "p.prev", F.explode_outer("p.rivals").alias("rival")
    )
    known = settled.select(F.col("seq").alias("rival"), F.col("choice"))
    return (
        exploded.join(small(known), "rival", "left")
        .groupBy("seq", "pos", "prev")
        .agg(
            F.collect_list(F.when(F.col("choice").isNull(), F.col("rival"))).alias("rivals"),
            F.coalesce(F.bool_or(F.col("choice") == F.col("prev")), F.lit(False)).alias("taken"),
        )
        .groupBy("seq")
        .agg(
            F.array_sort(
                F.collect_list(F.when(~F.col("taken"), F.struct("pos", "prev", "rivals")))
            ).alias("prefs")
        )
    )


def _first_choice(prefs: Column) -> Column:
    """-1 when nothing is left to pick, the first candidate when nobody rivals it, else null."""
    first = F.try_element_at(prefs, F.lit(1))
    return F.when(F.size(prefs) == 0, F.lit(-1).cast("long")).when(
        F.size(first["rivals"]) == 0, first["prev"]
    )


def choose_predecessors(
    candidates: DataFrame, rows_per_range: int = 1_000_000
) -> DataFrame:
    """``(seq, prev)``: the posting row each batch row replaces, for those that replace one."""
    state = cut(
        _with_rivals(candidates).withColumn("choice", _first_choice(F.col("prefs"))), "choices"
    )
    settled = [state.where(F.col("choice").isNotNull()).select("seq", "choice")]
    pending = state.where(F.col("choice").isNull()).select("seq", "prefs")
    left = pending.count()
    newest = settled[0]
    while left:
        # Every pass settles at least all rows of the earliest open range.
        pending = _apply_settled(pending, newest)
        ranges = math.ceil(left / rows_per_range)
        local = pending.repartitionByRange(ranges, "seq").sortWithinPartitions("seq")
        picks = local.mapInPandas(_settle_partition, "seq bigint, choice bigint")
        state = cut(pending.join(shuffled(picks), "seq"), "choices") if ranges > 1 else cut(picks, "choices")
        newest = state.where(F.col("choice").isNotNull()).select("seq", "choice")
        settled.append(newest)
        if ranges == 1:
            break
        pending = state.where(F.col("choice").isNull()).select("seq", "prefs")
        left = pending.count()
    picked = settled[0]
    for part in settled[1:]:
        picked = picked.unionByName(part)
    return picked.where(F.col("choice") >= 0).select("seq", F.col("choice").alias("prev"))


def follow_chains(edges: DataFrame) -> DataFrame:
    """``(seq, slot)`` from ``(seq, prev)``: the first row of each chain, by pointer doubling.

    Every open row points at a different row, so the join key is never skewed, and the
    distance covered doubles each round.
    """
    table = cut(edges.select("seq", F.col("prev").alias("slot"), F.lit(False).alias("done")), "chains")
    while True:
        ahead = table.select(
            F.col("seq").alias("slot"), F.col("slot").alias("further"), F.col("done").alias("far_done")
        )
        moved = (
            table.where(~F.col("done"))
            .join(small(ahead), "slot", "left")
            .select(
                "seq",
                F.coalesce("further", "slot").alias("slot"),
                F.coalesce("far_done", F.lit(True)).alias("done"),
            )
        )
        table = cut(moved.unionByName(table.where("done")), "chains")
        if table.where(~F.col("done")).isEmpty():
            return table.select("seq", "slot")


def assign_slots(
    store_keys: DataFrame | None,
    batch_keys: DataFrame,
    blocks: int | None = None,
    rows_per_range: int = 1_000_000,
) -> DataFrame:
    """``(seq, slot)`` for every batch row that replaces something; all others are their own slot."""
    picks = choose_predecessors(_candidates(store_keys, batch_keys, blocks), rows_per_range)
    return follow_chains(picks)


def stack_batches(store: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Store and batch in one frame with an ``is_store`` flag."""
    incoming = batch.withColumn("is_store", F.lit(False))
    if store is None:
        return incoming
    return store.withColumn("is_store", F.lit(True)).unionByName(incoming, allowMissingColumns=True)


def merge_slots(rows: DataFrame, slots: DataFrame, now: str) -> DataFrame:
    """One posting per slot. ``rows`` carries ``is_store``; ``slots`` is ``(seq, slot)``.

    Only ids, dates and the two short arrays of replaced rows are gathered; the wide fields
    come from the last row alone, by one join on ``seq``.
    """
    firsts = slots.select(F.col("slot").alias("seq"), "slot").distinct()
    members = slots.unionByName(firsts)
    origin = F.coalesce(F.col("discoveredFrom"), F.array("source"))
    thin = rows.select(
        "seq", "id", "discoveredAt", "is_store", origin.alias("discoveredFrom"), "matchedProfiles"
    ).join(small(members, BROADCAST_LINKS), "seq")
    facts = thin.groupBy("slot").agg(
        F.min_by(F.struct("id", "discoveredAt", "is_store"), "seq").alias("first"),
        F.max("seq").alias("last_seq"),
    )
    unions = ordered_union(thin, ["slot"], ["discoveredFrom", "matchedProfiles"], ["seq"])
    known = cut(facts.join(shuffled(unions), "slot"), "slot-facts")
    fate = (
        members.join(small(known), "slot")
        .select(
            "seq",
            F.struct(
                "slot",
                (F.col("seq") == F.col("last_seq")).alias("kept"),
                F.col("first.id").alias("id"),
                F.when(F.col("first.is_store"), F.col("first.discoveredAt"))
                .otherwise(F.lit(now))
                .alias("discoveredAt"),
                "discoveredFrom",
                "matchedProfiles",
            ).alias("fate"),
        )
    )
    fate = cut(fate, "fate")
    joined = rows.join(small(fate, BROADCAST_FATES), "seq", "left").where(F.col("fate").isNull() | F.col("fate.kept"))
    fresh = ~F.col("is_store")
    merged = F.col("fate").isNotNull()
    changed = {
        "seq": F.coalesce("fate.slot", "seq"),
        "id": F.when(merged, F.col("fate.id")).otherwise(F.col("id")),
        "discoveredAt": F.when(merged, F.col("fate.discoveredAt"))
        .when(fresh, F.lit(now))
        .otherwise(F.col("discoveredAt")),
        "lastSeenAt": F.when(merged | fresh, F.lit(now)).otherwise(F.col("lastSeenAt")),
        "discoveredFrom": F.when(merged, F.col("fate.discoveredFrom"))
        .when(fresh, origin)
        .otherwise(F.col("discoveredFrom")),
        "matchedProfiles": F.when(merged, F.col("fate.matchedProfiles")).otherwise(
            F.col("matchedProfiles")
        ),
    }
    return joined.select(
        *[changed[c].alias(c) if c in changed else F.col(c) for c in rows.columns if c != "is_store"]
    )


def merge_postings(
    store: DataFrame | None,
    batch: DataFrame,
    now: str,
    *,
    store_keys: DataFrame | None = None,
    blocks: int | None = None,
    rows_per_range: int = 1_000_000,
) -> DataFrame:
    """Merge ``batch`` into ``store``; the result keeps store order in ``seq``.

    ``store_keys`` may hold the key table published with the store, which saves hashing every
    stored description again.
    """
    return merge_with_keys(
        store, batch, now, store_keys=store_keys, blocks=blocks, rows_per_range=rows_per_range
    )[0]


def merge_with_keys(
    store: DataFrame | None,
    batch: DataFrame,
    now: str,
    *,
    store_keys: DataFrame | None = None,
    blocks: int | None = None,
    rows_per_range: int = 1_000_000,
) -> tuple[DataFrame, DataFrame]:
    """Like :func:`merge_postings`, and the key table of the result."""
    batch_keys = cut(tier_keys(batch), "batch-keys")
    if store is not None and store_keys is None:
        store_keys = cut(tier_keys(store), "store-keys")
    slots = assign_slots(store_keys, batch_keys, blocks, rows_per_range)
    merged = merge_slots(stack_batches(store, batch), slots, now)
    all_keys = batch_keys if store_keys is None else store_keys.unionByName(batch_keys)
    return merged, merged_keys(all_keys, slots)


def merged_keys(keys: DataFrame, slots: DataFrame) -> DataFrame:
    """Keys of the merged store: those of the last row of each slot."""
    members = slots.unionByName(slots.select(F.col("slot").alias("seq"), "slot").distinct())
    last = slots.groupBy("slot").agg(F.max("seq").alias("last_seq"))
    fate = cut(members.join(shuffled(last), "slot").select("seq", "slot", "last_seq"), "key-fates")
    joined = keys.join(small(fate, BROADCAST_LINKS), "seq", "left")
    return joined.where(F.col("slot").isNull() | (F.col("seq") == F.col("last_seq"))).select(
        F.coalesce("slot", "seq").alias("seq"), *TIERS
    )


def link_components(keys: DataFrame, hot_rows: int = 5_000_000) -> DataFrame:
    """``(seq, component)``: rows connected through shared tier keys, named by their first row.

    Each key links its rows to its first row. Then large and small stars alternate: every row
    hands the smallest of its neighbours to the larger ones, and then links the smaller ones and itself to
    the smallest of them. Rows without a link take no part. A round shortens every way by half or more; it ends
    when all links point at the first row of their component. Lookups of rows that many others point at
    are spread (:func:`lookup_join`).
    """
    links = tier_links(keys).select("seq", F.struct("tier", "key").alias("key"))
    firsts = links.groupBy("key").agg(F.min("seq").alias("to"), F.max("seq").alias("last"))
    firsts = firsts.where("to < last").select("key", "to")
    joined = lookup_join(links, firsts, "key", "inner", hot_rows)
    edges = cut(joined.where("seq <> to").select("seq", "to").distinct(), "links")
    state = _edge_state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("to").alias("seq"), F.col("seq").alias("to")))
        nearest = both.groupBy("seq").agg(F.min("to").alias("to")).select(
            F.col("seq").alias("to"), F.least("seq", "to").alias("first")
        )
        large = lookup_join(edges, nearest, "to", "inner", hot_rows)
        large = cut(large.select("seq", F.col("first").alias("to")).distinct(), "large-stars")
        first = large.groupBy("seq").agg(F.min("to").alias("first"))
        ends = F.explode(F.array("seq", "to")).alias("seq")
        small_stars = large.join(first, "seq").select(ends, F.col("first").alias("to")).where("seq <> to")
        edges = cut(small_stars.distinct(), "small-stars")
        before, state = state, _edge_state(edges)
        if state == before:
            break
    return keys.select("seq").join(edges, "seq", "left").select("seq", F.coalesce("to", "seq").alias("component"))


def _edge_state(edges: DataFrame) -> tuple:
    """How many links there are, and a hash of them all: equal only for equal sets."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("seq", "to"))).first())


def _dedup(df: DataFrame, key: Column) -> DataFrame:
    """One row per key: ``id`` and ``seq`` of the first row, every other field of the last.

    A row whose key is null forms a group of its own, so the table is read and keyed once.
    Aggregates are reduced before the shuffle, so a hot key costs one row per task.
    """
    fields = [c for c in df.columns if c not in ("id", "seq", KEY)]
    group = F.coalesce(_digest(key), F.encode(F.col("seq").cast("string"), "utf-8"))
    return (
        df.withColumn("__group", group)
        .groupBy("__group")
        .agg(
            F.min_by("id", "seq").alias("id"),
            F.min("seq").alias("first_seq"),
            F.max_by(F.struct(*fields), "seq").alias("last"),
        )
        .select(F.col("first_seq").alias("seq"), "id", "last.*")
        .select(*[c for c in df.columns if c != KEY])
    )


def dedup_by_url(df: DataFrame, url_col: str = "canonicalUrl") -> DataFrame:
    return _dedup(with_canonical_url(df, url_col, KEY), F.col(KEY))


def dedup_by_requisition(df: DataFrame) -> DataFrame:
    key = F.when(F.col("requisitionId") != "", F.concat_ws("::", "source", "requisitionId"))
    return _dedup(df, key)


def dedup_by_identity(df: DataFrame) -> DataFrame:
    key = F.when(
        has_usable_title(F.col("title")), norm_key(F.col("company"), F.col("title"), F.col("location"))
    )
    return _dedup(df, key)


def dedup_by_text(df: DataFrame, text_col: str = "descriptionText") -> DataFrame:
    key = F.when(has_fingerprintable(F.col(text_col)), fingerprint(F.col(text_col)))
    return _dedup(df, key)
