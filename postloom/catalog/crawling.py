"""Listing intake: seen ids, stop rules, caps, crawl planning."""

from pyspark.sql import functions as F

from postloom.catalog.base import NOW, query, table
from postloom.catalog.tagging import ROLES, roles
from postloom.operators.listings import (
    collapse_links, drop_seen, dry_stop, first_seen, link_stop, normalise_cards, progress_key,
    stall_stop, up_to_last_page,
)
from postloom.operators.progress import (
    crawl_frontier, progress_rollup, search_urls, seen_rollup,
)
from postloom.plans.discover import read_result_pages
from postloom.schemas import PROGRESS, SEEN_IDS
from postloom.sources.payloads import cap_pages, cap_per_source, take_first, total_stop


def events(spark, sf_dir):
    """Events as result cards: 100 consecutive events of one type make a page."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("key"),
        (F.floor(F.col("event_id") / 200) + 1).cast("int").alias("page_no"),
        F.col("event_id").alias("pos"),
        F.when(F.col("value") < 2, None).when(F.col("value") < 3, "").otherwise(F.col("user_id").cast("string")).alias("sourceJobId"),
    )


EVENTS = """cards as (select event_type as key, cast(event_id // 200 + 1 as integer) as page_no, event_id as pos,
    case when value < 2 then null when value < 3 then '' else cast(user_id as varchar) end as id from events)"""
SEEN = """seen as (select distinct event_type as key, cast(user_id as varchar) as id from events where value > 40)"""


def seen_ids(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(F.col("value") > 40)
    return e.select(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("source_job_id")).distinct()


@query(f"""with {EVENTS}, {SEEN}
    select key, page_no, pos, id as "sourceJobId" from cards where coalesce(id, '') = ''
    union all select key, page_no, pos, id from (select *, row_number() over (partition by key, id order by page_no, pos) as n
      from cards where coalesce(id, '') <> '') where n = 1 and (key, id) not in (select (key, id) from seen)""")
def unseen_listings(spark, sf_dir):
    return drop_seen(events(spark, sf_dir), seen_ids(spark, sf_dir), ["key"], "sourceJobId", ["page_no", "pos"])


@query(f"""with {EVENTS} select key, page_no, pos, id as "sourceJobId" from cards where coalesce(id, '') = ''
    union all select key, min(page_no), min(pos), id from cards where coalesce(id, '') <> '' group by key, id""")
def first_listings(spark, sf_dir):
    return first_seen(events(spark, sf_dir), ["key"], "sourceJobId", ["page_no", "pos"])


PAGES = f"""with {EVENTS}, {SEEN}, pages as (select key, page_no, count(*) as n_cards from cards group by all),
    fresh as (select key, page_no, count(*) as n from (select key, id, min(page_no) as page_no from cards
      where coalesce(id, '') <> '' and (key, id) not in (select (key, id) from seen) group by all) group by all),
    counted as (select p.*, coalesce(f.n, 0) as new_ids, lag(n_cards) over (partition by p.key order by p.page_no) as before
      from pages p left join fresh f on f.key = p.key and f.page_no = p.page_no)"""


def pages_of(cards):
    return cards.groupBy("key", "page_no").agg(F.count(F.lit(1)).alias("n_cards")).withColumn("start_page", F.lit(1))


@query(PAGES + """ select key, coalesce(min(case when new_ids = 0 and page_no > 1 then page_no end), max(page_no)) as last_page
    from counted group by key""")
def dry_pages(spark, sf_dir):
    cards = events(spark, sf_dir)
    stops = dry_stop(pages_of(cards), cards, ["key"], seen=seen_ids(spark, sf_dir), max_pages=None)
    return stops.select("key", "last_page")


@query(PAGES + """ select key, least(coalesce(min(case when n_cards = before then page_no - 1 end), max(page_no)),
    coalesce(min(case when new_ids = 0 then page_no end), max(page_no))) as last_page from counted group by key""")
def stalled_pages(spark, sf_dir):
    cards = events(spark, sf_dir)
    return stall_stop(pages_of(cards), cards, ["key"], seen=seen_ids(spark, sf_dir), max_pages=None)


@query(PAGES + """, stops as (select key, coalesce(min(case when new_ids = 0 and page_no > 1 then page_no end), max(page_no)) as last
    from counted group by key)
    select c.key, c.page_no, count(*) as n from cards c join stops s on s.key = c.key and c.page_no <= s.last group by all""")
def recorded_pages(spark, sf_dir):
    cards = events(spark, sf_dir)
    stops = dry_stop(pages_of(cards), cards, ["key"], seen=seen_ids(spark, sf_dir), max_pages=None)
    return up_to_last_page(cards, stops, ["key"]).groupBy("key", "page_no").agg(F.count(F.lit(1)).alias("n"))


@query("""with pages as (select o_orderstatus as site_id, o_orderpriority as search, o_orderkey // 200 + 1 as page_no,
      list('c' || o_custkey order by o_orderkey) as paths, count(*) as n from orders group by all),
    seen as (select *, sum(n) over w as rows from pages where page_no <= 100 window w as (partition by site_id, search order by page_no)),
    totals as (select o_orderstatus as site_id, o_orderpriority as search, count(*) * 3 // 4 as total from orders group by all),
    ended as (select s.*, coalesce(max(case when rows >= total then 1 else 0 end) over
        (partition by site_id, search order by page_no rows between unbounded preceding and 1 preceding), 0) as over
      from seen s join totals using (site_id, search)),
    read as (select * from ended where over = 0),
    firsts as (select site_id, path, min((search, page_no)) as ord from (select *, unnest(paths) as path from read) group by all),
    fresh as (select site_id, ord[1] as search, ord[2] as page_no, count(*) as fresh from firsts group by all),
    counted as (select r.*, sum(coalesce(fresh, 0)) over (partition by site_id order by search, page_no) as uniq
      from read r left join fresh using (site_id, search, page_no)),
    hit as (select *, coalesce(max(case when uniq >= 900 then 1 else 0 end) over
        (partition by site_id, search order by page_no rows between unbounded preceding and 1 preceding), 0) as hit from counted)
    select site_id, search, cast(page_no as integer) as page_no, cast(n as integer) as n from hit where hit = 0""")
def search_pages_read(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("site_id"), F.col("o_orderpriority").alias("search_no"), "o_orderkey",
        (F.floor(F.col("o_orderkey") / 200) + 1).cast("int").alias("page_no"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("path"),
    )
    totals = o.groupBy("site_id", "search_no").agg(F.floor(F.count(F.lit(1)) * 3 / 4).alias("total"))
    pages = o.groupBy("site_id", "search_no", "page_no").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "path"))).alias("p"))
    pages = pages.withColumn("paths", F.col("p.path")).drop("p").join(totals, ["site_id", "search_no"])
    read = total_stop(pages, 100, 900)
    return read.select("site_id", F.col("search_no").alias("search"), "page_no", F.size("paths").alias("n"))


LINKS = """links as (select event_type as site_id, user_id % 3 as search, cast(event_id // 200 + 1 as integer) as page_no,
    event_id as seq, 'https://x.com/' || (user_id * 31 % 97) as url, 'p' || (user_id % 3) as profile from events)"""


def link_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("site_id"), (F.col("user_id") % 3).alias("search"),
        (F.floor(F.col("event_id") / 200) + 1).cast("int").alias("page_no"), F.col("event_id").alias("seq"),
        F.concat(F.lit("https://x.com/"), (F.col("user_id") * 31 % 97).cast("string")).alias("url"),
        F.array(F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string"))).alias("matchedProfiles"),
    )


@query(f"""with {LINKS}, pages as (select site_id, search, page_no, count(*) % 17 > 0 as has_next from links group by all),
    fresh as (select site_id, search, page_no, count(*) as n from
      (select site_id, search, url, min(page_no) as page_no from links group by all) group by all)
    select site_id, search, least(coalesce(min(case when not has_next or (coalesce(n, 0) = 0 and page_no > 1) then page_no end),
      max(page_no)), max(page_no)) as last_page
    from pages left join fresh using (site_id, search, page_no) group by all""")
def career_pages(spark, sf_dir):
    links = link_rows(spark, sf_dir)
    pages = links.groupBy("site_id", "search", "page_no").agg((F.count(F.lit(1)) % 17 > 0).alias("has_next"))
    return link_stop(pages, links, ["site_id", "search"], max_pages=None)


@query(f"""with {LINKS}, firsts as (select site_id, search, url, min(seq) as seq, any_value(profile) as profile from links group by all),
    capped as (select *, row_number() over (partition by site_id, search order by seq) as n from firsts),
    sites as (select site_id, url, min(seq) as seq, array_to_string(list(profile order by seq), ',') as profiles from capped
      where n <= 20 group by all),
    ranked as (select *, row_number() over (partition by site_id order by seq) as n from sites)
    select site_id, url, seq, profiles from ranked where n <= 20""")
def career_links(spark, sf_dir):
    jobs = collapse_links(link_rows(spark, sf_dir), ["search"], 20)
    return jobs.select("site_id", "url", "seq", F.array_join("matchedProfiles", ",").alias("profiles"))


@query("""select o_orderstatus as site_id, o_orderkey as seq from (select *, row_number() over
    (partition by o_orderstatus order by o_orderkey) as n from orders) where n <= 2500""")
def source_cap(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("site_id"), F.col("o_orderkey").alias("seq"))
    return cap_per_source(orders, 2500)


@query(f"with {EVENTS} select key, page_no, count(*) as n from cards where page_no <= 20 group by all")
def page_cap(spark, sf_dir):
    return cap_pages(events(spark, sf_dir), 20).groupBy("key", "page_no").agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderkey as seq, o_orderstatus from orders order by o_orderkey limit 100")
def run_limit(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), "o_orderstatus")
    return take_first(orders, 100)


PROGRESS_SQL = """progress as (select lower(s_name) || '::' || lower(p_name) || '::united states' as key, min(s_name) as source,
    min(p_name) as keyword, cast(count(*) as integer) as last_page, count(*) % 2 = 1 as completed
    from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey group by 1)"""


def progress(spark, sf_dir):
    lines, part, supplier = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    joined = lines.join(part, F.col("p_partkey") == F.col("l_partkey")).join(supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    key = progress_key(F.col("s_name"), F.col("p_name"), F.lit("United States"))
    return joined.groupBy(key.alias("key")).agg(
        F.min("s_name").alias("source"), F.min("p_name").alias("keyword"), F.lit("United States").alias("location"),
        F.count(F.lit(1)).cast("int").alias("lastPage"), (F.count(F.lit(1)) % 2 == 1).alias("completed"),
        F.lit("2025-01-01").alias("lastUpdated"),
    )


@query(f"""with {ROLES}, {PROGRESS_SQL}, items as (select s_name as source, w.keyword, w.profile, w.pos,
      lower(s_name) || '::' || lower(w.keyword) || '::united states' as key
      from supplier, (select profile, unnest(keywords) as keyword, unnest(range(len(keywords))) as pos from roles) w)
    select i.key, i.source, i.keyword, i.profile, i.pos, coalesce(p.last_page, 0) + 1 as start_page
    from items i left join progress p using (key) where not coalesce(p.completed, false)""")
def frontier(spark, sf_dir):
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seq"), F.col("s_name").alias("source"))
    items = crawl_frontier(sources, roles(spark, sf_dir), progress(spark, sf_dir))
    return items.select("key", "source", "keyword", "profile", "pos", "start_page")


@query("""with items as (select o_orderkey, (['indeed', 'linkedin-public', 'monster', 'google-jobs', 'own'])[o_orderkey % 5 + 1] as source,
      o_orderpriority || ' (QA & ops)!' as keyword, 'New York/' || o_orderstatus as location, unnest(range(o_orderkey % 3 + 1, 4)) as page_no from orders),
    enc as (select *, replace(replace(keyword, '&', '%26'), ' ', '%20') as k, replace(replace(location, '/', '%2F'), ' ', '%20') as l from items)
    select o_orderkey, page_no, case source
      when 'indeed' then 'https://www.indeed.com/jobs?q=' || k || '&l=' || l || '&start=' || (page_no - 1) * 10
      when 'linkedin-public' then 'https://www.linkedin.com/jobs/search?keywords=' || k || '&location=' || l || '&start=' || (page_no - 1) * 25
      when 'monster' then 'https://www.monster.com/jobs/search?q=' || k || '&where=' || l || '&page=' || page_no
      when 'google-jobs' then 'https://www.google.com/search?q=' || k || '%20jobs%20' || l || '&ibp=htl;jobs'
      else 'https://own.com/' || page_no || '?q=' || k || '&q2={{keyword}}&l=' || l end as url from enc""")
def capture_urls(spark, sf_dir):
    names = F.array(*[F.lit(s) for s in ("indeed", "linkedin-public", "monster", "google-jobs", "own")])
    items = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.element_at(names, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("source"),
        F.concat("o_orderpriority", F.lit(" (QA & ops)!")).alias("keyword"),
        F.concat(F.lit("New York/"), "o_orderstatus").alias("location"),
        (F.col("o_orderkey") % 3 + 1).cast("int").alias("start_page"),
        F.lit("https://own.com/{{page}}?q={{keyword}}&q2={{keyword}}&l={{location}}").alias("template"),
    )
    return search_urls(items, 3, "template").select("o_orderkey", F.col("page_no").cast("long").alias("page_no"), "url")


@query(f"""with {PROGRESS_SQL}, run as (select lower(s_name) || '::' || lower(p_name) || '::united states' as key,
      max(case when l_linenumber < 7 then l_linenumber end) as page, bool_and(l_linenumber < 7) as done, min(s_name) as source
      from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey group by 1)
    select key, coalesce(p.source, r.source) as source, coalesce(r.page, p.last_page, 0) as "lastPage",
      coalesce(r.done, p.completed) as completed, case when r.key is null then '2025-01-01' else '2025-06-01T00:00:00.000Z' end as "lastUpdated"
    from progress p full join run r using (key)""")
def progress_update(spark, sf_dir):
    lines, part, supplier = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    pages = (
        lines.join(part, F.col("p_partkey") == F.col("l_partkey"))
        .join(supplier, F.col("s_suppkey") == F.col("l_suppkey"))
        .select(
            progress_key(F.col("s_name"), F.col("p_name"), F.lit("United States")).alias("key"),
            F.col("s_name").alias("source"), F.col("p_name").alias("keyword"), F.lit("United States").alias("location"),
            F.col("l_linenumber").alias("page_no"), (F.col("l_linenumber") >= 7).alias("failed"),
        )
    )
    done = progress_rollup(pages, progress(spark, sf_dir), NOW)
    return done.select("key", "source", "lastPage", "completed", "lastUpdated")


@query(f"""with {EVENTS}, {SEEN} select key, source_job_id, min(first_seq) as first_seq from (
      select key, id as source_job_id, -1 as first_seq from seen
      union all select key, id, pos from cards where coalesce(id, '') <> '') group by all""")
def seen_update(spark, sf_dir):
    cards = events(spark, sf_dir).withColumnRenamed("pos", "seq")
    return seen_rollup(cards, seen_ids(spark, sf_dir).withColumn("first_seq", F.lit(-1).cast("long")))


CARD_SQL = """cards as (select o_orderkey as seq, (['indeed', 'linkedin-public', 'monster', 'google-jobs', 'own'])[o_orderkey % 5 + 1] as source,
    case when o_orderkey % 23 = 0 then '' else 'Clerk ' || o_orderpriority end as title, o_orderstatus || ' Co' as company,
    case when o_orderkey % 19 = 0 then '' else 'https://h.com/rc/view/' || case when o_custkey % 2 = 0 then cast(o_custkey as varchar)
      else 'clerk-' || o_custkey end || case when o_custkey % 3 = 0 then '?jk=k' || o_custkey || '&x=1' else '' end end as href,
    case when o_custkey % 5 = 0 then 'urn:li:' || o_orderkey when o_custkey % 5 = 1 then 'urn:' end as urn,
    case when o_custkey % 4 = 0 then 'j' || o_custkey end as job_id, case when o_custkey % 4 = 1 then 'e' || o_custkey end as element_id
    from orders)"""


@query(f"""with {CARD_SQL}, ids as (select *, case source
      when 'indeed' then nullif(regexp_extract(href, '[?&]jk=([^&]+)', 1), '')
      when 'linkedin-public' then coalesce(nullif(regexp_extract(urn, '([^:]*)$', 1), ''), nullif(regexp_extract(href, 'view/(\\d+)', 1), ''),
        nullif(regexp_extract(href, 'view/([a-zA-Z0-9-]+)', 1), ''), href)
      when 'google-jobs' then coalesce(job_id, element_id, title || '::' || company)
      else regexp_extract(split_part(href, '?', 1), '([^/]*)$', 1) end as "sourceJobId"
    from cards where title <> '' and (source = 'google-jobs' or href <> ''))
    select seq, source, title, company, "sourceJobId", case when source = 'google-jobs' then 'https://www.google.com/search?q='
      || replace(title || ' ' || company, ' ', '%20') || '&ibp=htl;jobs#fpstate=tldetail&htidocid='
      || replace(replace("sourceJobId", ' ', '%20'), '::', '%3A%3A') else href end as "resultUrl" from ids""")
def portal_listings(spark, sf_dir):
    names = F.array(*[F.lit(s) for s in ("indeed", "linkedin-public", "monster", "google-jobs", "own")])
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    text = cust.cast("string")
    slug = F.when(cust % 2 == 0, text).otherwise(F.concat(F.lit("clerk-"), text))
    tail = F.when(cust % 3 == 0, F.concat(F.lit("?jk=k"), text, F.lit("&x=1"))).otherwise("")
    nothing = F.lit(None).cast("string")
    cards = table(spark, sf_dir, "orders").select(
        key.alias("seq"),
        F.element_at(names, (key % 5 + 1).cast("int")).alias("source"),
        F.lit("kw").alias("keyword"),
        F.when(key % 23 == 0, "").otherwise(F.concat(F.lit("Clerk "), "o_orderpriority")).alias("title"),
        F.concat("o_orderstatus", F.lit(" Co")).alias("company"),
        F.when(key % 19 == 0, "").otherwise(F.concat(F.lit("https://h.com/rc/view/"), slug, tail)).alias("href"),
        F.when(cust % 5 == 0, F.concat(F.lit("urn:li:"), key.cast("string"))).when(cust % 5 == 1, "urn:").alias("entity_urn"),
        F.when(cust % 4 == 0, F.concat(F.lit("j"), text)).alias("data_job_id"),
        F.when(cust % 4 == 1, F.concat(F.lit("e"), text)).alias("element_id"),
        F.lit("").alias("location_text"), nothing.alias("salary"), nothing.alias("age"),
    )
    return normalise_cards(cards, NOW).select("seq", "source", "title", "company", "sourceJobId", "resultUrl")


@query("""with visited as (select l_orderkey as k, l_linenumber as page, min(l_partkey) as part, min(l_suppkey) % 11 = 0 as failed,
      min(l_quantity) >= 47 as empty from lineitem group by all),
    fresh as (select *, not failed and not empty and row_number() over (partition by k, case when failed or empty then -page else part end
      order by page) = 1 as new from visited),
    stops as (select k, least(coalesce(min(case when empty and not failed then page - 1 end), 99),
      coalesce(min(case when not new and not failed and page > 1 then page end), 99), max(page)) as last from fresh group by k),
    ends as (select k, min(case when failed and page <= last then page end) as broken, any_value(last) as last
      from fresh join stops using (k) group by k)
    select 'indeed::order ' || e.k || '::united states' as key, coalesce(max(f.page), 0) as "lastPage", any_value(broken) is null as completed
    from ends e left join fresh f on f.k = e.k and not failed and not empty and page <= last and page < coalesce(broken, 99)
    group by e.k""")
def discover_progress(spark, sf_dir):
    """Result pages with challenges and empty pages among them: how far each search came."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        *[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity")]
    )
    word = F.concat(F.lit("order "), F.col("l_orderkey").cast("string"))
    found = F.format_string(
        '<div class="job_seen_beacon"><a class="jcs-JobTitle" href="/rc/clk?jk=%d&x=1"><span id="jobTitle-1">QA</span></a></div>', "l_partkey"
    )
    html = F.when(F.col("l_suppkey") % 11 == 0, "<p>Please verify you are human</p>").when(F.col("l_quantity") >= 47, "<p></p>")
    pages = lines.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.lit("indeed").alias("source"), word.alias("keyword"),
        F.lit("United States").alias("location"), F.col("l_linenumber").cast("int").alias("page_no"),
        F.lit("https://www.indeed.com/jobs?q=x").alias("url"), html.otherwise(found).alias("html"),
    )
    todo = pages.select("source", "keyword", "location").distinct().select(
        progress_key(F.col("source"), F.col("keyword"), F.col("location")).alias("key"),
        F.lit("p").alias("profile"), F.lit(0).alias("role_seq"), F.lit(0).alias("pos"), F.lit(1).alias("start_page"),
    )
    seen = spark.createDataFrame([], SEEN_IDS)
    _, read = read_result_pages(pages, todo, seen, NOW)
    return progress_rollup(read, spark.createDataFrame([], PROGRESS), NOW).select("key", "lastPage", "completed")
