"""Result pages end to end, and the stop rules one by one."""

import json

import pytest
from pyspark.sql import functions as F

from postloom.operators.listings import drop_seen, dry_stop, link_stop, stall_stop
from postloom.operators.ordered import first_n_in_key, lag_in_key, lookup_join
from postloom.operators.progress import crawl_frontier, resume_cursor, target_sources
from postloom.operators.resolve import match_company
from postloom.plans.companies import company_listings
from postloom.plans.discover import discover, resolve
from postloom.sources.extract import extract_cards, unusable_sources
from postloom.schemas import PROGRESS, RAW_PAGE, RAW_PAYLOAD, REGISTRY, ROLE, SEEN_IDS, SITE
from postloom.operators.profiles import match_profiles, tag_listings

NOW = "2026-03-01T00:00:00.000Z"
ROLES = [(0, "r0", "sdet", ["SDET"]), (1, "r1", "cloud", ["Cloud"])]
REGISTRY_ROWS = [
    (0, "AHEAD", None, "thinkahead.com", "https://jobs.lever.co/thinkahead", "lever", "thinkahead", "verified", None),
    (1, "Walmart", 1, "walmart.com", "https://careers.walmart.com", "workday", "walmart", "verified", None),
    (2, "Google", 8, "google.com", "https://www.google.com/about/careers", "greenhouse", "google", "verified", None),
]
LISTING = (
    "seq long, source string, searchKeyword string, title string, company string, location string, salarySnippet string, "
    "resultUrl string, sourceJobId string, matchedProfiles array<string>"
)


def card(title, key, company="Acme"):
    return (
        f'<div class="job_seen_beacon"><a class="jcs-JobTitle" href="/rc/clk?jk={key}&x=1"><span id="jobTitle-{key}">{title}</span></a>'
        f'<span data-testid="company-name"> {company} </span><div data-testid="text-location">Remote</div></div>'
    )


def page(seq, number, *cards, source="indeed", keyword="SDET"):
    return (seq, source, keyword, "United States", number, "https://www.indeed.com/jobs?q=x", "<html><body>" + "".join(cards) + "</body></html>")


def google(seq, number, *titles):
    cards = "".join(f'<li data-job-id="g-{t}"><h3>{t}</h3><span class="theCompany">G Co</span><span>2 days ago</span></li>' for t in titles)
    return (seq, "google-jobs", "SDET", "United States", number, "https://www.google.com/search", f"<ul>{cards}</ul>")


def test_discover_end_to_end(spark):
    pages = spark.createDataFrame(
        [
            page(1, 1, card("SDET II", "a"), card("Chef", "b"), card("", "skip")),
            page(2, 2, card("SDET III", "c"), card("SDET II", "a")),
            page(3, 3, card("SDET II", "a"), card("Chef", "b")),
            page(4, 4, card("Never read", "d")),
            google(5, 1, "One"), google(6, 2, "One", "Two"), google(7, 3, "Three", "Two"),
        ],
        RAW_PAGE,
    )
    roles = spark.createDataFrame(ROLES, ROLE)
    sites = spark.createDataFrame([], SITE)
    progress, seen = spark.createDataFrame([], PROGRESS), spark.createDataFrame([("indeed::sdet::united states", "b", 0)], SEEN_IDS)
    todo = crawl_frontier(target_sources(sites, ["Indeed", "google-jobs"]), roles, progress)
    assert todo.count() == 4
    redirects = spark.createDataFrame([("https://www.indeed.com/rc/clk?jk=a&x=1", "https://jobs.lever.co/thinkahead/1")], "url string, final_url string")
    details = spark.createDataFrame(
        [("https://jobs.lever.co/thinkahead/1", "lever", '{"text":"SDET at AHEAD","hostedUrl":"https://jobs.lever.co/thinkahead/1","descriptionPlain":"4 years"}')],
        "final_url string, ats string, body string",
    )
    long_text = "word " * 60
    detail_pages = spark.createDataFrame(
        [("https://www.indeed.com/rc/clk?jk=c&x=1", "", f"<body><main>short</main><div class='job-description'><p>{long_text}</p></div></body>")],
        "final_url string, page_title string, html string",
    )
    registry = spark.createDataFrame(REGISTRY_ROWS, REGISTRY)
    run = discover(pages, todo, roles, registry, redirects, details, detail_pages, progress, seen, None, NOW, exclude_hosts=["www.google.com"])
    listings = {(r.source, r.title): r for r in run.listings.collect()}
    assert sorted(listings) == [("google-jobs", "One"), ("google-jobs", "Two"), ("indeed", "SDET II"), ("indeed", "SDET III")]
    assert listings[("indeed", "SDET II")].matchedProfiles == ["sdet", "cloud"]
    assert listings[("google-jobs", "One")].matchedProfiles == ["sdet"]
    assert listings[("google-jobs", "One")].postingAgeOrDate == "2 days ago"
    assert listings[("indeed", "SDET II")].company == "Acme"
    rows = {r.title: r for r in run.store.collect()}
    ahead = rows["SDET at AHEAD"]
    assert (ahead.company, ahead.sourceType, ahead.source, ahead.requiredYears) == ("AHEAD", "company-careers", "company-careers::ahead", 4)
    assert (ahead.discoveredFrom, ahead.discoveredUrl) == (["indeed"], "https://www.indeed.com/rc/clk?jk=a&x=1")
    fallback = rows["Job Posting"]
    assert (fallback.location, fallback.descriptionText) == ("Remote/Various", long_text.strip())
    stub = rows["Two"]
    assert stub.descriptionText == "Job posting found on google-jobs. Full description not extracted."
    done = {r.key: (r.lastPage, r.completed) for r in run.progress.collect()}
    assert done == {"indeed::sdet::united states": (3, True), "google-jobs::sdet::united states": (2, True)}
    s = run.summary.first()
    # Both google results carry the same stub text, so the second took the place of the first.
    assert (s.sourcesAttempted, s.listingsDiscovered, s.jdsExtracted, s.jobsWritten) == (2, 4, 4, 3)
    assert {(r.key[:6], r.source_job_id) for r in run.seen.collect()} == {("indeed", "a"), ("indeed", "b"), ("indeed", "c"), ("google", "g-One"), ("google", "g-Two")}


def run_pages(spark, rows, progress=(), **options):
    roles = spark.createDataFrame(ROLES, ROLE)
    done = spark.createDataFrame(list(progress), PROGRESS)
    todo = crawl_frontier(target_sources(spark.createDataFrame([], SITE), ["Indeed"]), roles, done)
    empty = spark.createDataFrame([], "url string, final_url string")
    return discover(
        spark.createDataFrame(rows, RAW_PAGE), todo, roles, spark.createDataFrame(REGISTRY_ROWS, REGISTRY), empty,
        spark.createDataFrame([], "final_url string, ats string, body string"),
        spark.createDataFrame([], "final_url string, page_title string, html string"),
        done, spark.createDataFrame([], SEEN_IDS), None, NOW, **options,
    )


def test_a_challenge_holds_the_search_and_an_empty_one_is_done(spark):
    wall = "<p>Please verify you are human</p>"
    rows = [
        page(1, 1, card("SDET I", "a")), page(2, 2, wall), page(3, 3, card("SDET II", "b")),
        page(4, 1, keyword="Cloud"),
    ]
    run = run_pages(spark, rows)
    progress = {r.keyword: (r.lastPage, r.completed) for r in run.progress.collect()}
    assert progress == {"SDET": (1, False), "Cloud": (0, True)}
    assert [r.title for r in run.listings.collect()] == ["SDET I"]
    row = run.summary.first()
    assert (row.sourcesAttempted, row.sourcesSucceeded, row.sourcesFailed) == (1, 0, 1)
    assert [(r.search, r.page_no) for r in run.errors.collect()] == [("indeed::SDET", 2)]
    # The next run goes on from the page that failed.
    again = run_pages(
        spark, [page(5, 2, card("SDET III", "c")), page(6, 3, card("SDET II", "b")), page(7, 4)],
        [tuple(r) for r in run.progress.collect()],
    )
    progress = {r.keyword: (r.lastPage, r.completed) for r in again.progress.collect()}
    assert progress == {"SDET": (3, True), "Cloud": (0, True)}


def test_a_challenge_after_the_end_is_no_failure(spark):
    wall = "<p>Please verify you are human</p>"
    run = run_pages(spark, [page(1, 1, card("SDET I", "a")), page(2, 2, card("SDET I", "a")), page(3, 3, wall)])
    assert [(r.lastPage, r.completed) for r in run.progress.collect()] == [(2, True)]
    assert run.errors.count() == 0


def test_unusable_selectors_are_reported_and_end_nothing(spark):
    rows = [page(1, 1, card("SDET I", "a")), page(2, 1, "<i>x</i>", source="odd"), page(3, 1, source="none"), page(4, 1, source="half")]
    pages = spark.createDataFrame(rows, RAW_PAGE)
    selectors = {
        "odd": {"card": "a > b"}, "gap": {"card": None}, "half": {"card": "html", "title": "a > b"},
    }
    cards = extract_cards(pages, selectors).collect()
    assert sorted((r.source, r.title) for r in cards) == [("half", ""), ("indeed", "SDET I")]
    told = {r.source: r.message for r in unusable_sources(pages, selectors).collect()}
    assert told == {
        "odd": "unsupported selector: a > b", "none": "no selectors for this source", "half": "unsupported selector: a > b",
    }


def test_resolution_preferences(spark):
    def listing(seq, url):
        return (seq, "indeed", "kw", f"Listed {seq}", "Seen", "NY", "$1", url, f"j{seq}", ["p"])

    urls = {
        1: "https://boards.greenhouse.io/x/jobs/1", 2: "https://jobs.lever.co/x/2", 3: "https://careers.walmart.com/a/b/R3",
        4: "https://careers.walmart.com/a/b/R4", 5: "https://elsewhere.org/5", 6: "not a url",
    }
    listings = spark.createDataFrame([listing(i, u) for i, u in urls.items()], LISTING)
    bodies = spark.createDataFrame(
        [(urls[3], "workday", '{"jobPostingInfo":{"jobReqId":"R-3"}}'), (urls[4], "workday", "<html>")], "final_url string, ats string, body string"
    )
    pages = spark.createDataFrame([(urls[4], "Page title", "<body>whole body</body>")], "final_url string, page_title string, html string")
    none = spark.createDataFrame([], "url string, final_url string")
    good, bad = resolve(listings, none, spark.createDataFrame(REGISTRY_ROWS, REGISTRY), bodies, pages, NOW)
    rows = {r.seq: r for r in good.collect()}
    assert sorted(rows) == [1, 3, 4, 5, 6]
    assert (rows[1].title, rows[1].descriptionText, rows[1].requisitionId) == ("Listed 1", "", urls[1])
    assert (rows[3].company, rows[3].requisitionId, rows[3].title) == ("Walmart", "R-3", "Listed 3")
    assert (rows[4].title, rows[4].descriptionText, rows[4].location) == ("Page title", "whole body", "Remote/Various")
    assert (rows[5].company, rows[5].salaryText, rows[5].requisitionId) == ("Seen", "$1", "j5")
    assert rows[6].sourceType == "portal"
    assert [(r.seq, r.resolve_error) for r in bad.collect()] == [(2, "posting detail has no URL")]


def test_company_match_first_wins_and_large_registry(spark):
    urls = ["https://WWW.Walmart.com/x?next=google.com", "https://x.com/?u=thinkahead.com", "http://walmart", "thinkahead.com", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, final_url string")
    registry = spark.createDataFrame(REGISTRY_ROWS, REGISTRY)
    for limit in (2_000, 0):
        got = {r.i: r.match and r.match.company for r in match_company(df, registry, inline_limit=limit).collect()}
        assert got == {0: "Walmart", 1: "AHEAD", 2: None, 3: None, 4: None}
    hosts = {r.i: r.match and r.match.company for r in match_company(df, registry, host_only=True).collect()}
    assert hosts == {0: "Walmart", 1: None, 2: None, 3: None, 4: None}


def test_profile_match_large_and_small_agree(spark):
    searches = spark.createDataFrame([(0, "qa", ["a"]), (1, "Cloud Eng", ["b", "a"]), (2, "", ["c"]), (3, "x", ["d"])], "search_no long, keyword string, profileIds array<string>")
    df = spark.createDataFrame([(0, "cloud engineer, QA"), (1, "none"), (2, "CLOUD ENGine"), (3, None)], "i int, t string")
    expected = {0: ["a", "b"], 1: [], 2: ["b", "a"], 3: []}
    for limit in (2_000, 0):
        found = match_profiles(df, "t", searches, inline_limit=limit)
        assert {r.i: r.matchedProfiles for r in found.collect()} == expected


def test_tagging_per_keyword(spark):
    rows = spark.createDataFrame([("Cloud cook", "SDET", "sdet"), ("Cook", "SDET", "sdet")], "title string, searchKeyword string, role_profile string")
    roles = spark.createDataFrame(ROLES, ROLE)
    assert [r.matchedProfiles for r in tag_listings(rows, roles, per_keyword=True).orderBy("title").collect()] == [["cloud"], ["sdet"]]
    assert [r.matchedProfiles for r in tag_listings(rows, roles).orderBy("title").collect()] == [["sdet"], ["sdet"]]


def cards_of(spark, pages):
    rows = [("k", p, i, x) for p, ids in pages.items() for i, x in enumerate(ids)]
    cards = spark.createDataFrame(rows, "key string, page_no int, pos int, sourceJobId string")
    table = spark.createDataFrame([("k", p, min(pages), len(ids)) for p, ids in pages.items()], "key string, page_no int, start_page int, n_cards int")
    return table, cards


@pytest.mark.parametrize(
    "pages, dry, stall",
    [
        ({1: ["a"], 2: ["a"], 3: ["b"]}, 2, 1),
        ({1: ["a"], 2: ["b", "a"], 3: []}, 2, 2),
        ({1: [None], 2: ["a", "b"], 3: ["c"]}, 3, 1),
        ({4: ["s"], 5: ["t", "u"], 6: ["u"]}, 6, 4),
        ({1: ["a"], 2: [None, None], 3: ["z"]}, 2, 2),
    ],
)
def test_stop_rules(spark, pages, dry, stall):
    table, cards = cards_of(spark, pages)
    seen = spark.createDataFrame([("k", "s")], "key string, source_job_id string")
    assert dry_stop(table, cards, ["key"], seen=seen).first().last_page == dry
    assert stall_stop(table, cards, ["key"], seen=seen).first().last_page == stall
    assert stall_stop(table, cards, ["key"], seen=seen, blocks=3).first().last_page == stall


def test_link_stop(spark):
    links = spark.createDataFrame([("s", 1, "u1"), ("s", 2, "u2"), ("s", 3, "u1"), ("s", 4, "u9")], "key string, page_no int, url string")
    pages = spark.createDataFrame([("s", p, True) for p in (1, 2, 3, 4)], "key string, page_no int, has_next boolean")
    assert link_stop(pages, links, ["key"]).first().last_page == 3
    last = pages.withColumn("has_next", F.col("page_no") < 2)
    assert link_stop(last, links, ["key"]).first().last_page == 2


def test_drop_seen_keeps_rows_without_id(spark):
    rows = spark.createDataFrame([("k", 1, 0, None), ("k", 1, 1, ""), ("k", 1, 2, "a"), ("k", 2, 0, "a"), ("j", 1, 0, "a"), ("k", 2, 1, "old")], "key string, page_no int, pos int, id string")
    seen = spark.createDataFrame([("k", "old")], "key string, source_job_id string")
    got = {(r.key, r.page_no, r.pos) for r in drop_seen(rows, seen, ["key"], "id", ["page_no", "pos"]).collect()}
    assert got == {("k", 1, 0), ("k", 1, 1), ("k", 1, 2), ("j", 1, 0)}


def test_resume_cursor(spark):
    rows = spark.createDataFrame([("k", 0, False), ("k", 1, True), ("k", 2, True), ("j", 4, False)], "key string, idx int, failed boolean")
    assert {r.key: r.cursor for r in resume_cursor(rows, ["key"]).collect()} == {"k": 1, "j": 5}


def test_blocked_helpers_equal_plain_ones(spark):
    rows = [(("hot" if i % 3 else f"k{i % 7}"), i * 3, i) for i in range(500)]
    df = spark.createDataFrame(rows, "key string, seq long, v int").repartition(5)
    plain = {r.seq: r.p for r in lag_in_key(df, ["key"], "seq", "v", "p", 1).collect()}
    assert {r.seq: r.p for r in lag_in_key(df, ["key"], "seq", "v", "p", 6).collect()} == plain
    short = {r.seq for r in first_n_in_key(df, ["key"], "seq", 50, 1).collect()}
    assert {r.seq for r in first_n_in_key(df, ["key"], "seq", 50, 6).collect()} == short
    names = spark.createDataFrame([("hot", "H"), ("k1", "K")], "key string, name string")
    wide = {(r.seq, r.name) for r in lookup_join(df, names, "key", hot_rows=40).collect()}
    assert wide == {(r.seq, r.name) for r in df.join(names, "key", "left").collect()}
    assert lookup_join(df, names, "key", "left_anti", hot_rows=40).count() == df.join(names, "key", "left_anti").count()


def test_company_boards_to_listings(spark):
    board = lambda *jobs: json.dumps({"jobs": [{"id": i, "title": t, "absolute_url": f"https://g.com/{i}", "location": {"name": "Oslo"}} for i, t in jobs]})
    registry = spark.createDataFrame(
        [
            (0, "Alpha", None, "alpha.com", "https://boards.greenhouse.io/alpha", "greenhouse", None, "verified", None),
            (1, "Beta", None, "beta.com", "https://beta.com", "workday", None, "verified", None),
            (2, "Gamma", None, "gamma.com", "https://gamma.com", "lever", "gamma", "verified", None),
            (3, "Delta", None, "delta.com", "https://delta.com", "greenhouse", "delta", "verified", None),
        ],
        REGISTRY,
    )
    payloads = spark.createDataFrame(
        [
            (1, "company-careers::alpha", "greenhouse", None, 1, "u", 200, None, board((1, "SDET"), (2, "Chef"), (3, "SDET II"))),
            (2, "company-careers::gamma", "lever", None, 1, "u", 200, None, "oops"),
            (3, "company-careers::delta", "greenhouse", None, 1, "u", 200, None, board((1, "Cloud"))),
        ],
        RAW_PAYLOAD,
    )
    searches = spark.createDataFrame([(0, "sdet", ["sdet"])], "search_no long, keyword string, profileIds array<string>")
    seen = spark.createDataFrame([("company-careers::sdet::us", "alpha::3", 0)], SEEN_IDS)
    run = company_listings(registry, payloads, searches, seen, "SDET", "US", "sdet", NOW)
    rows = {(r.company, r.sourceJobId): r for r in run.listings.collect()}
    assert sorted(rows) == [("Alpha", "1"), ("Alpha", "2"), ("Delta", "1")]
    assert rows["Alpha", "1"].matchedProfiles == ["sdet"] and rows["Alpha", "1"].location == "Oslo"
    assert [r.company for r in run.skipped.collect()] == ["Beta"]
    assert [r.message for r in run.errors.collect()] == ['Lever site "gamma" returned a non-JSON response']
    assert run.cursor.first().cursor == 2
