"""Cleaning, keying and classifying columns."""

from pyspark.sql import functions as F

from postloom.catalog.base import (
    query, sql_canonical, sql_clean, sql_fingerprint, sql_generic, sql_norm, sql_years, table,
)
from postloom.functions.text import (
    has_fingerprintable, has_usable_title, is_generic_title, norm_key, with_clean_text,
    with_fingerprint, with_required_years,
)
from postloom.functions.urls import (
    job_id, with_ats, with_ats_identity, with_canonical_url, with_detail_key,
)
from postloom.operators.quality import challenge_report


@query(f"select page_id, {sql_clean('html')} as text from pages")
def clean_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return with_clean_text(pages, "html", "text").select("page_id", "text")


@query(f"""select doc_id, {sql_years("text || ' needs ' || (n_chars % 140) || '+ years'")} as years
    from documents""")
def required_years(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    built = docs.withColumn(
        "ask", F.concat("text", F.lit(" needs "), (F.col("n_chars") % 140).cast("string"), F.lit("+ years"))
    )
    return with_required_years(built, "ask", "years").select("doc_id", "years")


@query(f"""select doc_id, {sql_fingerprint('text')} as fingerprint,
    length(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))) >= 10 as usable
    from documents""")
def fingerprints(spark, sf_dir):
    docs = with_fingerprint(table(spark, sf_dir, "documents"), "text")
    return docs.select("doc_id", "fingerprint", has_fingerprintable(F.col("text")).alias("usable"))


@query(f"""select page_id, variant, url_key, substr(sha256(url_key), 1, 16) as id from (
    {sql_canonical('''select page_id, variant, case when variant = 0 then url
      when contains(url, '?') or contains(url, '#') then 'HTTP://' || upper(split_part(url, '/', 3)) || '/x/'
      else url || '?b=2&UTM_x=1&gh_src=9&a=1#top' end as u
      from pages, (values (0), (1)) v(variant)''')})""")
def canonical_urls(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    plain = ~(F.col("url").contains("?") | F.col("url").contains("#"))
    other = F.when(plain, F.concat("url", F.lit("?b=2&UTM_x=1&gh_src=9&a=1#top"))).otherwise(
        F.concat(F.lit("HTTP://"), F.upper(F.split_part("url", F.lit("/"), F.lit(3))), F.lit("/x/"))
    )
    both = pages.select("page_id", F.posexplode(F.array("url", other)).alias("variant", "u"))
    keyed = with_canonical_url(both, "u", "url_key")
    return keyed.select("page_id", "variant", "url_key", job_id(F.col("url_key")).alias("id"))


ODD_SQL = """select page_id, variant, url, case variant
      when 0 then replace(url, '://', '://u:p@') when 1 then regexp_replace(url, '^(https://[^/?#]+)', '\\1:000443')
      when 2 then regexp_replace(url, '://([^/?#]+)', '://\\1:' || repeat('7', 5000))
      when 3 then regexp_replace(url, '://([^/?#]+)', '://\\1:٣') when 4 then regexp_replace(url, '://([^/?#]+)/', '://\\1/a/./b/../../')
      when 5 then regexp_replace(url, '://([^/?#]+)', '://\\1:8443') else '  ' || url || chr(10) end as odd
    from pages, (values (0), (1), (2), (3), (4), (5), (6)) v(variant)"""


@query(f"""with odd as ({ODD_SQL}), plain as ({sql_canonical('select distinct url as u from pages')})
    select page_id, variant, case variant when 0 then replace(url_key, '://', '://u:p@')
      when 1 then url_key when 2 then odd when 3 then odd
      when 5 then regexp_replace(url_key, '://([^/?#]+)', '://\\1:8443') else url_key end as url_key
    from odd join plain on plain.u = odd.url""")
def odd_urls(spark, sf_dir):
    """User names, ports of every kind, dot segments and padding in real addresses."""
    url, host = F.col("url"), r"://([^/?#]+)"
    odd = [
        F.replace(url, F.lit("://"), F.lit("://u:p@")),
        F.regexp_replace(url, "^(https://[^/?#]+)", "$1:000443"),
        F.regexp_replace(url, host, "://$1:" + "7" * 5000),
        F.regexp_replace(url, host, "://$1:٣"),
        F.regexp_replace(url, host + "/", "://$1/a/./b/../../"),
        F.regexp_replace(url, host, "://$1:8443"),
        F.concat(F.lit("  "), url, F.lit("\n")),
    ]
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.array(*odd)).alias("variant", "odd"))
    return with_canonical_url(rows, "odd", "url_key").select("page_id", "variant", "url_key")


TITLE_SQL = """case p_size % 6 when 0 then '  QA   Engineer! ' when 1 then 'Engineer -' when 2 then '  '
    when 3 then 'Senior ' || upper(p_name) else p_name end"""


def _titles(part):
    size = F.col("p_size") % 6
    return part.withColumn(
        "title",
        F.when(size == 0, "  QA   Engineer! ").when(size == 1, "Engineer -").when(size == 2, "  ")
        .when(size == 3, F.concat(F.lit("Senior "), F.upper("p_name"))).otherwise(F.col("p_name")),
    )


@query(f"""select p_partkey, key, generic, length(trim(title)) > 0 and not generic as usable from (
    select p_partkey, title, {sql_norm('p_brand')} || '::' || {sql_norm('title')} || '::' || {sql_norm('p_type')}
      as key, {sql_generic('title')} as generic
    from (select *, {TITLE_SQL} as title from part))""")
def identity_keys(spark, sf_dir):
    part = _titles(table(spark, sf_dir, "part"))
    return part.select(
        "p_partkey",
        norm_key(F.col("p_brand"), F.col("title"), F.col("p_type")).alias("key"),
        is_generic_title(F.col("title")).alias("generic"),
        has_usable_title(F.col("title")).alias("usable"),
    )


ATS_URL_SQL = """case o_orderkey % 5
    when 0 then 'https://boards.Greenhouse.io/' || o_orderstatus || '/jobs/' || o_orderkey || '?t=1'
    when 1 then 'https://jobs.lever.co/' || lower(o_orderstatus) || '/' || o_orderkey || '/apply'
    when 2 then 'https://acme.wd' || (o_orderkey % 7) || '.myworkdayjobs.com/en/ext' || o_custkey || '/Site/job/R' || o_orderkey
    when 3 then 'https://x.myworkdayjobs.com/' || o_orderkey
    else 'https://www.example.com/jobs?jobs=' || o_orderkey || '&z=1' end"""


def ats_url():
    key = F.col("o_orderkey").cast("string")
    way = F.col("o_orderkey") % 5
    return (
        F.when(way == 0, F.concat(F.lit("https://boards.Greenhouse.io/"), "o_orderstatus", F.lit("/jobs/"), key, F.lit("?t=1")))
        .when(way == 1, F.concat(F.lit("https://jobs.lever.co/"), F.lower("o_orderstatus"), F.lit("/"), key, F.lit("/apply")))
        .when(
            way == 2,
            F.concat(
                F.lit("https://acme.wd"), (F.col("o_orderkey") % 7).cast("string"),
                F.lit(".myworkdayjobs.com/en/ext"), F.col("o_custkey").cast("string"), F.lit("/Site/job/R"), key,
            ),
        )
        .when(way == 3, F.concat(F.lit("https://x.myworkdayjobs.com/"), key))
        .otherwise(F.concat(F.lit("https://www.example.com/jobs?jobs="), key, F.lit("&z=1")))
    )


@query(f"""select o_orderkey, ats,
    case when ats = 'greenhouse' then coalesce(given, regexp_extract(u, '(?i)boards\\.greenhouse\\.io/([^/?#]+)', 1)) end as board_token,
    case when ats = 'lever' then coalesce(given, regexp_extract(u, '(?i)jobs\\.lever\\.co/([^/?#]+)', 1)) end as lever_slug,
    case when ats = 'workday' then split_part(u, '/', 3) end as hostname,
    case when ats = 'workday' then coalesce(given, split_part(u, '/', 5)) end as tenant,
    case when ats = 'workday' then coalesce(nullif(split_part(u, '/', 6), ''), 'careers') end as site,
    case when ats = 'workday' then split_part(u, '/', 6) = '' end as guessed,
    case ats when 'greenhouse' then regexp_extract(u, 'jobs/(\\d+)', 1) when 'lever' then split_part(u, '/', 5)
      when 'workday' then regexp_extract(u, '([^/]*)$', 1) end as detail_key
    from (select o_orderkey, u, case when o_custkey % 4 = 0 then 'given' || o_custkey end as given,
      case when contains(lower(u), 'greenhouse.io') then 'greenhouse' when contains(lower(u), 'lever.co') then 'lever'
        when contains(lower(u), 'myworkdayjobs.com') then 'workday' end as ats
      from (select *, {ATS_URL_SQL} as u from orders))""")
def ats_identity(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumns(
        {
            "u": ats_url(),
            "given": F.when(F.col("o_custkey") % 4 == 0, F.concat(F.lit("given"), F.col("o_custkey").cast("string"))),
        }
    )
    known = with_ats_identity(with_ats(orders, "u"), "u", "ats", "given")
    return with_detail_key(known, "u").select(
        "o_orderkey", "ats", "board_token", "lever_slug", "workday.hostname", "workday.tenant",
        "workday.site", "workday.guessed", "detail_key",
    )


PAGE_TITLES = [
    "Solve the reCAPTCHA", "HCaptcha", "Cloudflare security Challenge", "cf-turnstile", "PerimeterX", "DataDome",
    "Please verify you are HUMAN", "Access denied: automated tool", "Automated queries detected", "Careers",
    "cloudflare\nchallenge",
]


@query(f"""select 'site' || (page_id % 7) as source, reason, count(*) as n from (
    select page_id, case
      when regexp_matches(hay, '(?i)recaptcha') then 'reCAPTCHA detected'
      when regexp_matches(hay, '(?i)hcaptcha') then 'hCaptcha detected'
      when regexp_matches(hay, '(?i)cf-turnstile|checking your browser|cloudflare[^\\n\\r]*challenge')
        then 'Cloudflare Turnstile / challenge detected'
      when regexp_matches(hay, '(?i)perimeterx|_px-captcha') then 'PerimeterX detected'
      when regexp_matches(hay, '(?i)datadome') then 'DataDome detected'
      when regexp_matches(hay, '(?i)verify you are human|are you a robot') then 'Generic human-verification phrasing detected'
      when regexp_matches(hay, '(?is)access denied.{{0,80}}(bot|automated)|automated (queries|requests) detected')
        then 'Access-denied / bot-block page detected' end as reason
    from (select page_id, ({[t.replace(chr(10), '@') for t in PAGE_TITLES]!r})[page_id % {len(PAGE_TITLES)} + 1]
      || chr(10) || html as hay0, replace(hay0, '@', chr(10)) as hay from pages))
    where reason is not null group by all""")
def challenge_counts(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    titles = F.array(*[F.lit(t) for t in PAGE_TITLES])
    built = pages.select(
        F.concat(F.lit("site"), (F.col("page_id") % 7).cast("string")).alias("source"),
        F.element_at(titles, (F.col("page_id") % len(PAGE_TITLES) + 1).cast("int")).alias("title"),
        "html",
    )
    return challenge_report(built)
