"""Duplicate removal and the tiered merge."""

from pyspark.sql import functions as F

from postloom.catalog.base import NOW, SQL, query, sql_canonical, sql_fingerprint, sql_generic, sql_norm, table
from postloom.catalog.keys import TITLE_SQL, _titles
from postloom.operators.merge import (
    dedup_by_identity, dedup_by_requisition, dedup_by_text, dedup_by_url, link_components,
    merge_postings, tier_keys, tier_links,
)
from postloom.session import cut
from postloom.sources.store import (
    ROWS_PER_RANGE, publish_postings, publish_ranges, read_postings, read_published, split_points,
)
from postloom.streaming.intake import merge_version
from postloom.session import scratch_root


def _first_last(key: str, src: str, fields: str) -> str:
    """First id and seq, last fields, per key of ``src``; rows without a key stay."""
    last = ", ".join(f"arg_max({f}, seq) as {f}" for f in fields.split(", "))
    return (
        f"select min(seq) as seq, arg_min(id, seq) as id, {last} from ({src}) where {key} is not null group by {key} "
        f"union all select seq, id, {fields} from ({src}) where {key} is null"
    )


@query(_first_last(
    "url_key",
    sql_canonical("""select page_id * 2 + v as seq, 'p' || page_id || '-' || v as id, v as variant,
      case v when 0 then split_part(url, '#', 1) || case when contains(url, '?') then '&' else '?' end || 'utm_source=a' else url || '#frag' end as u
      from (select page_id, unnest([0, 1]) as v, case when contains(url, '?') then url else split_part(url, '#', 1) end as url from pages)"""),
    "u, variant",
))
def url_dedup(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    bare = F.when(F.col("url").contains("?"), F.col("url")).otherwise(F.substring_index("url", "#", 1))
    base = F.substring_index("bare", "#", 1)
    tracked = F.concat(base, F.when(F.col("bare").contains("?"), "&").otherwise("?"), F.lit("utm_source=a"))
    rows = pages.withColumn("bare", bare).select(
        "page_id", F.posexplode(F.array(tracked, F.concat("bare", F.lit("#frag")))).alias("variant", "u")
    ).select(
        (F.col("page_id") * 2 + F.col("variant")).alias("seq"),
        F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit("-"), F.col("variant").cast("string")).alias("id"),
        "u", "variant",
    )
    return dedup_by_url(rows, "u")


@query(_first_last(
    "key",
    """select o_orderkey as seq, 'o' || o_orderkey as id, o_orderstatus as source, o_totalprice as price, o_orderpriority as priority,
      case when o_custkey % 10 > 0 then o_orderstatus || '::' || o_custkey end as key from orders""",
    "source, price, priority",
))
def requisition_dedup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"),
        F.col("o_orderstatus").alias("source"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"),
        F.when(F.col("o_custkey") % 10 > 0, F.col("o_custkey").cast("string")).otherwise("").alias("requisitionId"),
    )
    return dedup_by_requisition(orders).drop("requisitionId")


@query(_first_last(
    "key",
    f"""select *, case when length(trim(title)) > 0 and not {sql_generic('title')}
        then {sql_norm('company')} || '::' || {sql_norm('title')} || '::' || {sql_norm('location')} end as key
      from (select p_partkey as seq, 'q' || p_partkey as id, p_brand as company, {TITLE_SQL} as title, p_type as location,
        p_retailprice as price from part)""",
    "company, title, location, price",
))
def identity_dedup(spark, sf_dir):
    part = _titles(table(spark, sf_dir, "part")).select(
        F.col("p_partkey").alias("seq"), F.concat(F.lit("q"), F.col("p_partkey").cast("string")).alias("id"),
        F.col("p_brand").alias("company"), "title", F.col("p_type").alias("location"), F.col("p_retailprice").alias("price"),
    )
    return dedup_by_identity(part)


@query(_first_last(
    "key",
    f"""select doc_id as seq, 'd' || doc_id as id, lang, source, n_chars,
      case when length(trim(text)) >= 10 then {sql_fingerprint('text')} end as key from documents""",
    "lang, source, n_chars",
))
def text_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"),
        "lang", "source", "n_chars", F.col("text").alias("descriptionText"),
    )
    return dedup_by_text(docs).drop("descriptionText")


BATCH_AT = 1 << 40


def postings(spark, sf_dir):
    """Documents as postings; odd ids arrive as the batch, after all even ones."""
    d = table(spark, sf_dir, "documents")
    key, text = F.col("doc_id"), F.col("doc_id").cast("string")
    size = F.col("n_chars")
    url = F.when(key % 3 == 0, F.floor(key / 2).cast("string")).otherwise(F.concat(F.lit("u"), text))
    odd = key % 2 == 1
    none = F.lit(None).cast("string")
    return d.select(
        F.when(odd, key + BATCH_AT).otherwise(key).alias("seq"),
        odd.alias("is_batch"),
        F.concat(F.lit("d"), text).alias("id"),
        "source", F.lit("portal").alias("sourceType"), F.col("source").alias("company"),
        F.when(F.col("lang") == "de", "Engineer").otherwise(F.concat(F.lit("Role "), (size % 400).cast("string"))).alias("title"),
        F.col("lang").alias("location"), none.alias("remoteType"), none.alias("employmentType"), none.alias("department"),
        F.when(size % 5 == 0, (size / 5).cast("long").cast("string")).otherwise("").alias("requisitionId"),
        none.alias("postingDate"), F.lit("2024-01-01").alias("discoveredAt"), F.lit("2024-01-02").alias("lastSeenAt"),
        F.concat(F.lit("https://Jobs.example.com/"), url, F.lit("/?utm_source=x")).alias("canonicalUrl"),
        F.concat(F.lit("https://jobs.example.com/"), url).alias("applyUrl"),
        F.col("text").alias("descriptionText"), none.alias("descriptionHtml"), F.lit(None).cast("int").alias("requiredYears"),
        none.alias("salaryText"), F.array("lang").alias("matchedProfiles"),
        F.when(odd, F.array("source")).otherwise(F.array(F.lit("seed"), F.col("source"))).alias("discoveredFrom"),
        none.alias("discoveredUrl"), F.lit("{}").alias("rawMetadata"),
    )


def split_postings(spark, sf_dir):
    rows = postings(spark, sf_dir)
    return rows.where(~F.col("is_batch")).drop("is_batch"), rows.where("is_batch").drop("is_batch")


POSTINGS = f"""docs as (select case when doc_id % 2 = 1 then doc_id + {BATCH_AT} else doc_id end as seq, doc_id % 2 = 0 as is_store,
    'd' || doc_id as id, source, lang, text, case when lang = 'de' then 'Engineer' else 'Role ' || n_chars % 400 end as title,
    case when n_chars % 5 = 0 then cast(n_chars // 5 as varchar) else '' end as req,
    case when doc_id % 3 = 0 then cast(doc_id // 2 as varchar) else 'u' || doc_id end as page,
    case when doc_id % 2 = 1 then [source] else ['seed', source] end as origin from documents),
  keyed as materialized (select *, 'https://jobs.example.com/' || page as k1, case when req <> '' then source || '::' || req end as k2,
    case when lang <> 'de' then {sql_norm('source')} || '::' || {sql_norm('title')} || '::' || {sql_norm('lang')} end as k3,
    case when length(trim(text)) >= 10 then {sql_fingerprint('text')} end as k4 from docs)"""

LINKED = POSTINGS + """, linked as materialized (select *,
    lag(seq) over (partition by k1 order by seq) as p1,
    case when k2 is not null then lag(seq) over (partition by k2 order by seq) end as p2,
    case when k3 is not null then lag(seq) over (partition by k3 order by seq) end as p3,
    case when k4 is not null then lag(seq) over (partition by k4 order by seq) end as p4 from keyed)"""


@query(f"""with recursive {LINKED},
  queue as materialized (select row_number() over (order by seq) as i, seq, p1, p2, p3, p4 from linked where not is_store),
  fold(i, seq, pick, taken) as (
    select cast(0 as bigint), cast(-1 as bigint), cast(null as bigint), cast([] as bigint[])
    union all
    select i, seq, pick, case when pick is null then taken else list_append(taken, pick) end from (
      select q.i, q.seq, f.taken, case when p1 is not null and not list_contains(f.taken, p1) then p1
        when p2 is not null and not list_contains(f.taken, p2) then p2
        when p3 is not null and not list_contains(f.taken, p3) then p3
        when p4 is not null and not list_contains(f.taken, p4) then p4 end as pick
      from fold f join queue q on q.i = f.i + 1)),
  picks as materialized (select seq, pick from fold where pick is not null),
  walk(seq, ord) as (select seq, pick from picks union all select w.seq, p.pick from walk w join picks p on p.seq = w.ord),
  slots as (select seq, min(ord) as slot from walk group by 1),
  members as (select k.*, coalesce(s.slot, k.seq) as slot from keyed k left join slots s using (seq)),
  origins as (select slot, array_to_string(list(o order by ord), ',') as origins from (select slot, o, min((seq, pos)) as ord from
    (select slot, seq, unnest(origin) as o, unnest(range(len(origin))) as pos from members) group by all) group by 1),
  tags as (select slot, array_to_string(list(lang order by ord), ',') as profiles from
    (select slot, lang, min(seq) as ord from members group by all) group by 1)
  select slot as seq, arg_min(id, seq) as id, case when bool_or(is_store and seq = slot) then '2024-01-01' else '{NOW}' end as "discoveredAt",
    case when count(*) = 1 and bool_and(is_store) then '2024-01-02' else '{NOW}' end as "lastSeenAt", arg_max(title, seq) as title,
    arg_max(req, seq) as "requisitionId", arg_max(page, seq) as page, any_value(origins) as origins, any_value(profiles) as profiles
  from members join origins using (slot) join tags using (slot) group by slot""")
def tiered_merge(spark, sf_dir):
    store, batch = split_postings(spark, sf_dir)
    merged = merge_postings(store, batch, NOW)
    return merged.select(
        "seq", "id", "discoveredAt", "lastSeenAt", "title", "requisitionId",
        F.regexp_extract("applyUrl", r"([^/]*)$", 1).alias("page"),
        F.array_join("discoveredFrom", ",").alias("origins"), F.array_join("matchedProfiles", ",").alias("profiles"),
    )


@query(f"""with {POSTINGS}, links as (select 1 as tier, k1 as k from keyed union all select 2, k2 from keyed union all select 3, k3 from keyed
    union all select 4, k4 from keyed)
  select tier, n as rows_sharing, count(*) as keys from (select tier, k, count(*) as n from links where k is not null group by all) group by all""")
def shared_keys(spark, sf_dir):
    links = tier_links(tier_keys(postings(spark, sf_dir)))
    sizes = links.groupBy("tier", "key").agg(F.count(F.lit(1)).alias("rows_sharing"))
    return sizes.groupBy("tier", "rows_sharing").agg(F.count(F.lit(1)).alias("keys"))


@query(f"""with recursive {LINKED}, near as (select seq, p1 as p from linked union select seq, p2 from linked union select seq, p3 from linked
    union select seq, p4 from linked), edges as (select seq as a, p as b from near where p is not null union
    select p, seq from near where p is not null),
  reach(seq, ord) as (select seq, seq from keyed union select r.seq, e.b from reach r join edges e on e.a = r.ord)
  select seq, min(ord) as component from reach group by 1""")
def components(spark, sf_dir):
    return link_components(cut(tier_keys(postings(spark, sf_dir)), "keys"))


@query("""select case when doc_id % 2 = 1 then doc_id + 1099511627776 else doc_id end as seq, 'd' || doc_id as id, lang as location,
    length(text) as chars from documents""")
def published_store(spark, sf_dir):
    """Postings written as a new version of a store and read back."""
    import uuid

    root = f"{scratch_root(spark)}/store-{uuid.uuid4().hex}"
    publish_postings(postings(spark, sf_dir).drop("is_batch"), root, fmt="json")
    good, _ = read_postings(spark, root)
    return good.select("seq", "id", "location", F.length("descriptionText").cast("long").alias("chars"))


@query(SQL["tiered_merge"])
def store_two_versions(spark, sf_dir):
    """The tiered merge through a ranged store: of the second version only changed ranges are written."""
    import uuid

    store, batch = split_postings(spark, sf_dir)
    root = f"{scratch_root(spark)}/store-{uuid.uuid4().hex}"
    publish_ranges(store.join(tier_keys(store), "seq"), root, 1, split_points(store.select("seq"), ROWS_PER_RANGE))
    merge_version(batch, root, 2, NOW)
    return read_published(spark, root).select(
        "seq", "id", "discoveredAt", "lastSeenAt", "title", "requisitionId",
        F.regexp_extract("applyUrl", r"([^/]*)$", 1).alias("page"),
        F.array_join("discoveredFrom", ",").alias("origins"), F.array_join("matchedProfiles", ",").alias("profiles"),
    )
