"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words. A document is first taken as many whole times as
is certain; the rest of a source's target is a sample of fixed size without replacement:
documents are ranked by random odds divided by inclusion odds, u/(1-u) over p/(1-p), and taken
in that order until the words are there. Only built-in column functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.session import cut

# Word separators and the order of weights: fixed values.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)

LEVEL_BITS = 10  # the ranking is cut into 2^10 cells, and the decisive cell into 2^10 again


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) fixed by the values of ``parts``: 52 bits of an MD5."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def ranked_groups(groups: DataFrame, key: str) -> DataFrame:
    """Add ``position``: 0, 1, 2, ... in the order of ``key`` (code points, null last).

    Ranges of the key are numbered side by side and shifted by the sizes of the ranges before,
    so that a long list of groups never meets in one task.
    """
    parts = groups.sparkSession.sparkContext.defaultParallelism
    order = [F.col(key).isNull(), F.col(key)]
    ranged = groups.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id())
    ranged = cut(ranged, "mix-ranges")
    sizes = ranged.groupBy("range").count()
    before = F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    shifts = sizes.select("range", F.coalesce(before, F.lit(0)).alias("shift"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return (
        ranged.join(shifts, "range")
        .withColumn("position", (place - 1 + F.col("shift")).cast("long"))
        .drop("range", "shift")
    )


def share_out(groups: DataFrame, total: float, share: str, limit: str) -> DataFrame:
    """Add ``target``: ``total`` shared in proportion to ``share``, none above its ``limit``.

    What a full group leaves over goes to the others by share, until none is above. Each
    round the driver reads three numbers; a round fills at least one more group or is the last.
    """
    level = 0.0
    while True:
        full = F.col(share) * F.lit(level) > F.col(limit)
        used, open_share, groups_full = groups.agg(
            F.sum(F.when(full, F.col(limit)).otherwise(0)),
            F.sum(F.when(~full, F.col(share)).otherwise(0)),
            F.sum(full.cast("long")),
        ).first()
        if not open_share:
            break
        next_level = (total - float(used)) / float(open_share)
        if next_level <= level:
            break
        level = next_level
    target = F.least(F.col(share) * F.lit(level), F.col(limit).cast("double"))
    return groups.withColumn("target", target.cast("double"))


def pareto_mix(
    documents: DataFrame,
    fraction: float = 1.5,
    max_copies: int = 2,
    weights: tuple[int, ...] = WEIGHTS,
    odds: str | None = None,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: list[str] | None = None,
) -> DataFrame:
    """``(id_col, size, source_size, target, copies, taken)`` for every document; with ``keep``
    those columns and ``copies`` instead. Texts are not shuffled, but for the few documents
    where a source's share ends.

    ``size`` is the number of words, ``source_size`` and ``target`` belong to the source,
    ``copies`` is how often the mix takes the document and ``taken`` is ``copies * size``.

    * A source takes whole documents in rank order. The last one is taken if that brings the
      source nearer to its target, so a source misses its target by half a document at most.
    * ``odds`` may name a column of positive numbers: documents with larger odds come sooner.
      Without it all documents of a source are equally likely. Null or other numbers count as 1.
    * Null sources form a source of their own, which comes last. Null or empty texts have size 0
      and take 0 words. Repeated rows are decided one by one. Null ids are allowed: the text
      stands in for the id. Other columns are ignored. An empty table gives an empty result.
    * The draw depends on the id and ``seed`` alone: reruns and other partitionings agree.
    """
    weight = F.lit(1.0) if odds is None else F.when(F.col(odds) > 0, F.col(odds).cast("double"))
    seen = documents.select(
        F.struct(*[F.col(c) for c in (keep or [id_col])]).alias("kept"),
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.coalesce(weight, F.lit(1.0)).alias("weight"),
        uniform(
            F.lit(str(seed)),
            F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit("")),
        ).alias("u"),
    )
    thin = cut(seen.drop("kept") if keep else seen, "mix-words")
    sources = targets(thin, fraction, max_copies, weights)
    keyed = ranked(thin, sources)

    # Where does the running total of words pass the need? First by coarse cell, then by fine.
    by_coarse = decisive(
        keyed.select("source", "need", "coarse", "size", F.lit(0).cast("long").alias("base")),
        "coarse",
    )
    by_coarse = cut(by_coarse, "mix-coarse").select(
        F.col("source").alias("of"), F.col("cell").alias("at"), "base"
    )
    inside = keyed.join(
        by_coarse, F.col("source").eqNullSafe(F.col("of")) & (F.col("coarse") == F.col("at"))
    )
    by_fine = decisive(inside.select("source", "need", "fine", "size", "base"), "fine")
    by_fine = cut(by_fine, "mix-fine").select(
        F.col("source").alias("of"), F.col("cell").alias("edge"), "base"
    )
    rows = ranked(seen, sources) if keep else keyed
    decided = rows.join(by_fine, F.col("source").eqNullSafe(F.col("of")), "left")
    at_cut = F.coalesce(F.col("fine") == F.col("edge"), F.lit(False))

    # Without a decisive cell all documents of the source do not reach the need: take them all.
    plain = decided.where(~at_cut).withColumn(
        "extra",
        F.when(F.col("need") <= 0, 0)
        .when(F.col("edge").isNull() | (F.col("fine") < F.col("edge")), 1)
        .otherwise(0),
    )
    upto = Window.partitionBy("source", "fine").orderBy("v", "id", "size", "u")
    upto = upto.rowsBetween(Window.unboundedPreceding, 0)
    after = F.col("base") + F.sum("size").over(upto)
    edge = decided.where(at_cut).withColumn("after", after)
    short_by = F.col("need") - (F.col("after") - F.col("size"))
    edge = edge.withColumn(
        "extra",
        F.when((short_by > 0) & (F.col("after") - F.col("need") <= short_by), 1).otherwise(0),
    ).drop("after")
    copies = F.col("whole") + F.col("extra")
    if keep:
        plain, edge = (d.select("kept.*", copies.cast("int").alias("copies")) for d in (plain, edge))
        return plain.unionByName(edge)
    return plain.unionByName(edge).select(
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        copies.cast("int").alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"),
    )


def ranked(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with the numbers of their source and their place in its ranking: ``v`` in (0, 1)
    grows with the ranking number, and ``fine`` and ``coarse`` are the cells it falls in."""
    same = F.col("source").eqNullSafe(F.col("of"))
    joined = rows.join(sources.withColumnRenamed("source", "of"), same).drop("of")
    # The odds of a document are those of its source times its own weight.
    odds = F.col("p") / (1 - F.col("p")) * F.col("weight")
    rank = F.col("u") / (1 - F.col("u")) / odds
    v = F.when(F.col("p") > 0, rank / (1 + rank)).otherwise(F.lit(1.0))
    cells = 1 << (2 * LEVEL_BITS)
    fine = F.least(F.floor(F.col("v") * F.lit(cells)), F.lit(cells - 1))
    return (
        joined.withColumn("v", v)
        .withColumn("fine", fine)
        .withColumn("coarse", F.shiftright("fine", LEVEL_BITS))
    )


def targets(
    sized: DataFrame, fraction: float, max_copies: int, weights: tuple[int, ...]
) -> DataFrame:
    """One row per source: size, target, certain copies, and words and odds of the sample."""
    groups = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    total = groups.agg(F.sum("source_size")).first()[0] or 0
    ranked = ranked_groups(groups, "source")
    share = F.element_at(
        F.array(*[F.lit(w) for w in weights]), (F.col("position") % len(weights) + 1).cast("int")
    )
    ranked = cut(
        ranked.withColumn("share", share).withColumn("limit", F.col("source_size") * max_copies),
        "mix-ranked",
    )
    size = F.col("source_size")
    ratio = F.when(size > 0, F.col("target") / size).otherwise(0.0)
    shared = share_out(ranked, fraction * total, "share", "limit").withColumn("ratio", ratio)
    whole = F.floor("ratio")
    return cut(
        shared.select(
            "source",
            "source_size",
            "target",
            whole.cast("long").alias("whole"),
            (F.col("target") - whole * size).alias("need"),
            (F.col("ratio") - whole).alias("p"),
        ),
        "mix-targets",
    )


def decisive(rows: DataFrame, cell: str) -> DataFrame:
    """``(source, cell, base)``: the cell in which the source's running words pass its need, and
    the words before it. A source has a bounded number of cells, whatever its size."""
    sums = rows.groupBy("source", F.col(cell).alias("cell")).agg(
        F.sum("size").alias("words"), F.first("need").alias("need"), F.first("base").alias("start")
    )
    window = Window.partitionBy("source").orderBy("cell")
    window = window.rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("start") + F.sum("words").over(window)
    return (
        sums.withColumn("upto", upto)
        .where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("words") < F.col("need")))
        .select("source", "cell", (F.col("upto") - F.col("words")).alias("base"))
    )


SQL = r"""
with recursive sized as (
  select doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    (('0x' || substr(md5('42|' || coalesce(doc_id::varchar, text, '')), 1, 13))::bigint + 0.5)
      / 4503599627370496.0::double as u
  from documents
), sources as (
  select source, sum(size)::bigint as source_size,
    ([3, 1, 2])[((row_number() over (order by source nulls last)) - 1) % 3 + 1] as share
  from sized group by source
), rounds as (
  select 0 as r, 0.0::double as level
  union all
  select r + 1, (select (1.5::double * sum(source_size)
      - sum(case when share * level > 2 * source_size then 2 * source_size else 0 end))
      / sum(case when share * level > 2 * source_size then 0 else share end) from sources)
  from rounds where r < 100 and (select sum(case when share * level > 2 * source_size then 0 else share end)
    from sources) > 0
), targets as (
  select *, least(share * (select max(level) from rounds), 2 * source_size)::double as target from sources
), parts as (
  select *, floor(case when source_size > 0 then target / source_size else 0 end) as whole,
    (case when source_size > 0 then target / source_size else 0 end)
      - floor(case when source_size > 0 then target / source_size else 0 end) as p
  from targets
), ranked as (
  select d.*, t.source_size, t.target, t.whole, t.target - t.whole * t.source_size as need,
    case when p > 0 then (u / (1 - u)) / (p / (1 - p)) end as q
  from sized d join parts t on d.source is not distinct from t.source
), summed as (
  select *, sum(size) over (partition by source order by q nulls last, doc_id, size
    rows unbounded preceding)::bigint as upto from ranked
)
select doc_id, size, source_size, target, copies::integer as copies, (copies * size)::bigint as taken
from (select *, whole + case when need > 0 and upto - size < need
    and upto - need <= need - (upto - size) then 1 else 0 end as copies from summed) x
"""
