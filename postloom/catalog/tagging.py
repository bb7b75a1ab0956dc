"""Profiles, registries and quality reports."""

from pyspark.sql import functions as F

from postloom.catalog.base import SQL, query, table
from postloom.operators.listings import company_career_listings
from postloom.operators.profiles import match_profiles, profile_totals, role_searches, tag_listings
from postloom.operators.progress import registry_coverage, registry_status, resume_cursor
from postloom.operators.quality import registry_violations as violations
from postloom.operators.resolve import follow_redirects, match_company
from postloom.catalog.base import NOW


def roles(spark, sf_dir):
    """One role per brand: its keywords are all part names of the brand, by their first part."""
    part = table(spark, sf_dir, "part")
    names = part.groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("at"))
    listed = names.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("at", "p_name"))).alias("names"))
    words = F.transform("names", lambda n, i: F.when(i == 0, F.upper(n["p_name"])).otherwise(n["p_name"]))
    return listed.select(
        F.regexp_extract("p_brand", r"(\d+)", 1).cast("long").alias("seq"),
        F.col("p_brand").alias("id"), F.col("p_brand").alias("profile"), words.alias("keywords"),
    )


ROLES = """roles as (select cast(regexp_extract(p_brand, '(\\d+)', 1) as bigint) as seq, p_brand as profile,
    [upper(names[1])] || names[2:] as keywords from (select p_brand, list(p_name order by first_key) as names
      from (select p_brand, p_name, min(p_partkey) as first_key from part group by all) group by p_brand))"""
SEARCHES = f"""{ROLES}, words as (select seq, profile, unnest(range(len(keywords))) as pos, lower(unnest(keywords)) as keyword from roles),
    firsts as (select keyword, profile, min(seq * 100000 + pos) as ord from words group by all),
    searches as (select keyword, min(ord) as no, list(profile order by ord) as profiles from firsts group by keyword)"""


@query(f"""with {SEARCHES} select keyword, array_to_string(profiles, ',') as profiles from searches""")
def role_keywords(spark, sf_dir):
    found = role_searches(roles(spark, sf_dir))
    return found.select("keyword", F.array_join("profileIds", ",").alias("profiles"))


TAGGED = f"""with {SEARCHES}, texts as (select p_partkey, p_name || ' / ' || upper(p_type) || ' ' || p_name as text from part),
    hits as (select t.p_partkey, s.no, unnest(s.profiles) as profile, unnest(range(len(s.profiles))) as pos
      from texts t join searches s on contains(lower(t.text), s.keyword)),
    tag_firsts as (select p_partkey, profile, min(no * 1000 + pos) as ord from hits group by all),
    tags as (select p_partkey, list(profile order by ord) as profiles from tag_firsts group by 1)"""


def _tagged(spark, sf_dir, **options):
    part = table(spark, sf_dir, "part").withColumn(
        "text", F.concat("p_name", F.lit(" / "), F.upper("p_type"), F.lit(" "), "p_name")
    )
    return match_profiles(part, "text", role_searches(roles(spark, sf_dir)), **options)


@query(TAGGED + """ select p.p_partkey, coalesce(array_to_string(g.profiles, ','), '') as profiles
    from part p left join tags g using (p_partkey)""")
def profile_match(spark, sf_dir):
    return _tagged(spark, sf_dir).select("p_partkey", F.array_join("matchedProfiles", ",").alias("profiles"))


@query(TAGGED + """ select p.p_partkey, coalesce(array_to_string(g.profiles, ','), '') as profiles
    from part p left join tags g using (p_partkey)""")
def profile_match_grams(spark, sf_dir):
    """The join on grams that large lists of keywords take."""
    found = _tagged(spark, sf_dir, inline_limit=0)
    return found.select("p_partkey", F.array_join("matchedProfiles", ",").alias("profiles"))


@query(TAGGED + " select profile, count(*) as n from (select unnest(profiles) as profile from tags) group by 1")
def profile_counts(spark, sf_dir):
    return profile_totals(_tagged(spark, sf_dir))


@query(f"""with {ROLES}, everyone as (select array_to_string(list(profile order by seq), ',') as p from roles)
    select p_partkey, keyword, case when contains(lower(p_name), lower(keyword)) then e.p else r.profile end as profiles
    from part join (select *, unnest(keywords) as keyword from roles) r on r.profile = p_brand, everyone e""")
def listing_tags(spark, sf_dir):
    brands = roles(spark, sf_dir)
    words = brands.select(F.col("profile").alias("role_profile"), F.explode("keywords").alias("searchKeyword"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), "p_brand")
    found = part.join(words, F.col("p_brand") == F.col("role_profile"))
    return tag_listings(found, brands).select(
        "p_partkey", F.col("searchKeyword").alias("keyword"), F.array_join("matchedProfiles", ",").alias("profiles")
    )


def page_registry(spark, sf_dir):
    """Companies named by the sites the pages come from."""
    pages = table(spark, sf_dir, "pages")
    domain = F.regexp_extract("url", r"([a-z-]+\.example\.[a-z]+)", 1)
    return pages.groupBy(domain.alias("corporateDomain")).agg(F.min("page_id").alias("seq")).select(
        "seq",
        F.upper("corporateDomain").alias("company"),
        F.upper("corporateDomain").alias("corporateDomain"),
        F.concat(F.lit("https://"), "corporateDomain", F.lit("/en/")).alias("careersUrl"),
        F.element_at(
            F.array(F.lit("greenhouse"), F.lit("lever"), F.lit("workday"), F.lit("generic")), (F.col("seq") % 4 + 1).cast("int")
        ).alias("atsType"),
        F.lit(None).cast("string").alias("atsTenantOrBoardId"),
    )


REGISTRY = """registry as (select regexp_extract(url, '([a-z-]+\\.example\\.[a-z]+)', 1) as domain, min(page_id) as seq
    from pages group by 1)"""


@query(f"""with {REGISTRY}, hits as (select page_id, min(r.seq) as seq from pages p join registry r
      on contains(lower(url || '?via=en'), r.domain) or contains(lower(url), 'https://' || r.domain || '/en/') group by 1)
    select p.page_id, upper(r.domain) as company, (['greenhouse', 'lever', 'workday', 'generic'])[r.seq % 4 + 1] as ats
    from pages p left join hits using (page_id) left join registry r on r.seq = hits.seq""")
def company_match(spark, sf_dir, **options):
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat("url", F.lit("?via=en")).alias("final_url"))
    found = match_company(pages, page_registry(spark, sf_dir), **options)
    return found.select("page_id", F.col("match.company").alias("company"), F.col("match.atsType").alias("ats"))


@query(SQL["company_match"])
def company_match_grams(spark, sf_dir):
    """The join on grams that large registries take."""
    return company_match(spark, sf_dir, inline_limit=0)


@query("""with moved as (select url, case page_id % 3 when 0 then '' when 1 then replace(url, 'http:', 'https:') end as final_url
      from pages)
    select p.page_id, p.hop, coalesce(nullif(m.final_url, ''), p.u) as final_url
    from (select page_id, hop, case hop when 0 then url else url || '#x' end as u from pages, (values (0), (1)) v(hop)) p
    left join moved m on m.url = p.u""")
def redirects(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    way = F.col("page_id") % 3
    moved = pages.select(
        "url", F.when(way == 0, "").when(way == 1, F.regexp_replace("url", "http:", "https:")).alias("final_url")
    )
    hops = pages.select("page_id", F.posexplode(F.array("url", F.concat("url", F.lit("#x")))).alias("hop", "resultUrl"))
    return follow_redirects(hops, moved).select("page_id", "hop", "final_url")


def customer_registry(spark, sf_dir):
    """Registry rows with every kind of mistake, made from customers."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(
        key.alias("seq"),
        F.when(key % 11 == 0, "").when(key % 13 == 0, None).otherwise(F.col("c_name")).alias("company"),
        F.floor("c_acctbal").cast("int").alias("fortuneRank"),
        F.when(key % 17 == 0, "").otherwise(F.concat(F.lower("c_mktsegment"), F.lit(".com"))).alias("corporateDomain"),
        F.when(key % 5 == 0, F.col("c_name")).otherwise(F.concat(F.lit("https://c.com/"), key.cast("string"))).alias("careersUrl"),
        F.when(F.col("c_mktsegment") == "BUILDING", "greenhouse").when(F.col("c_mktsegment") == "MACHINERY", "workday")
        .when(F.col("c_mktsegment") == "FURNITURE", "generic").when(F.col("c_mktsegment") == "HOUSEHOLD", "lever")
        .otherwise("taleo").alias("atsType"),
        F.when(key % 19 == 0, "").when(key % 2 == 0, F.col("c_name")).alias("atsTenantOrBoardId"),
        F.when(key % 7 == 0, "unknown").otherwise("verified").alias("verificationStatus"),
        F.lit(None).cast("string").alias("lastVerifiedDate"),
    )


CUSTOMERS = """registry as (select c_custkey as seq,
    case when c_custkey % 11 = 0 then '' when c_custkey % 13 = 0 then null else c_name end as company,
    cast(floor(c_acctbal) as integer) as rank, case when c_custkey % 17 = 0 then '' else lower(c_mktsegment) || '.com' end as domain,
    case when c_custkey % 5 = 0 then c_name else 'https://c.com/' || c_custkey end as careers,
    case c_mktsegment when 'BUILDING' then 'greenhouse' when 'MACHINERY' then 'workday' when 'FURNITURE' then 'generic'
      when 'HOUSEHOLD' then 'lever' else 'taleo' end as ats,
    case when c_custkey % 19 = 0 then '' when c_custkey % 2 = 0 then c_name end as tenant,
    case when c_custkey % 7 = 0 then 'unknown' else 'verified' end as status from customer)"""


@query(f"""with {CUSTOMERS}
    select seq, 'company' as field, 'Expected string, received null' as message from registry where company is null
    union all select seq, 'company', 'String must contain at least 1 character(s)' from registry where company = ''
    union all select seq, 'fortuneRank', 'Number must be greater than 0' from registry where rank <= 0
    union all select seq, 'corporateDomain', 'String must contain at least 1 character(s)' from registry where domain = ''
    union all select seq, 'careersUrl', 'Invalid url' from registry where careers not like 'https://%'
    union all select seq, 'atsType', 'Invalid enum value. Expected ''greenhouse'' | ''lever'' | ''workday'' | ''generic'', received '''
      || ats || '''' from registry where ats = 'taleo'
    union all select seq, 'atsTenantOrBoardId', 'String must contain at least 1 character(s)' from registry where tenant = ''
    union all select seq, 'verificationStatus', 'Invalid enum value. Expected ''verified'' | ''unverified'' | ''blocked'', received '''
      || status || '''' from registry where status = 'unknown'""")
def registry_violations(spark, sf_dir):
    return violations(customer_registry(spark, sf_dir))


@query(f"""with {CUSTOMERS} select count(*) filter (ats not in ('workday', 'generic')) as ready,
    count(*) filter (ats in ('workday', 'generic')) as skipped, count(*) as total from registry""")
def coverage(spark, sf_dir):
    return registry_coverage(customer_registry(spark, sf_dir))


@query(f"""with {CUSTOMERS} select seq, ats as "atsType", case when ats in ('workday', 'generic') then 'skipped' else 'ready' end as status,
    case ats when 'workday' then 'missing verified Workday ATS site identifier'
      when 'generic' then 'missing verified generic-portal selectors' end as reason,
    case ats when 'workday' then 'atsWorkdaySite' when 'generic' then 'genericSelectors' end as missing_field from registry""")
def coverage_detail(spark, sf_dir):
    return registry_status(customer_registry(spark, sf_dir)).drop("company")


@query("""select o_orderpriority as search, coalesce(min(case when o_totalprice > 499000 then o_orderkey end),
    max(o_orderkey) + 1) as cursor from orders group by 1""")
def company_cursor(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("search"), F.col("o_orderkey").alias("idx"), (F.col("o_totalprice") > 499000).alias("failed")
    )
    return resume_cursor(orders, ["search"])


@query("""select s_suppkey * 1000000 + p_partkey as seq, lower(s_name) || '::' || p_partkey as seen_id, 'kw' as "searchKeyword",
    s_name as company, p_name as title, coalesce(case when p_size % 3 > 0 then p_type end, '') as location,
    'https://x.com/' || p_partkey as "resultUrl", 'https://x.com/' || p_partkey as "possibleOfficialUrl",
    cast(p_partkey as varchar) as "sourceJobId", p_brand as profiles
    from (select distinct l_partkey, l_suppkey from lineitem) join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey""")
def career_listings(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    jobs = (
        pairs.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            (F.col("s_suppkey") * 1_000_000 + F.col("p_partkey")).alias("seq"),
            F.col("s_name").alias("company"),
            F.col("p_name").alias("title"),
            F.col("p_partkey").cast("string").alias("externalId"),
            F.concat(F.lit("https://x.com/"), F.col("p_partkey").cast("string")).alias("url"),
            F.array("p_brand").alias("matchedProfiles"),
            F.struct(
                F.when(F.col("p_size") % 3 > 0, F.col("p_type")).alias("location"), F.lit(None).cast("string").alias("salaryText")
            ).alias("detail"),
        )
    )
    found = company_career_listings(jobs, "kw", NOW)
    return found.select(
        "seq", "seen_id", "searchKeyword", "company", "title", "location", "resultUrl", "possibleOfficialUrl",
        "sourceJobId", F.array_join("matchedProfiles", ",").alias("profiles"),
    )
