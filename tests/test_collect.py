"""Configured sites end to end on landed payloads."""

import json

import pytest
from pyspark.sql import functions as F

from postloom.plans.collect import collect
from postloom.schemas import RAW_PAYLOAD, ROLE, SITE
from postloom.sources.payloads import position_seq, triage_payloads

NOW = "2026-03-01T00:00:00.000Z"


def site(seq, name, adapter, enabled=True, **block):
    row = dict(seq=seq, id=name, name=name.title(), url=f"https://{name}.com", adapter=adapter, enabled=enabled, **block)
    return tuple(row.get(f) for f in SITE.fieldNames())


def payload(seq, site_id, kind, body, keyword=None, page=1):
    text = body if isinstance(body, str) else json.dumps(body)
    return (seq, site_id, kind, keyword, page, "https://api", 200, None, text)


GH = {
    "jobs": [
        {"id": 101, "title": "Senior SDET", "absolute_url": "https://boards.greenhouse.io/acme/jobs/101?gh_src=x", "location": {"name": "Remote"},
         "departments": [{"name": "QA"}], "content": "<p>Needs 5+ years</p>", "updated_at": "2026-01-01"},
        {"id": 102, "title": "Chef", "absolute_url": "https://boards.greenhouse.io/acme/jobs/102"},
    ]
}
LEVER = [
    {"id": "ab", "text": "Cloud Engineer", "categories": {"commitment": "Full", "location": "NYC", "department": "Infra"},
     "hostedUrl": "https://jobs.lever.co/x/ab", "applyUrl": "https://jobs.lever.co/x/ab/apply", "description": "<b>Clouds</b>", "createdAt": 1735689600000},
]
SITES = [
    site(0, "acme", "greenhouse", greenhouse={"boardToken": "acme"}),
    site(1, "lever", "lever", lever={"site": "x"}),
    site(2, "wd", "workday", workday={"hostname": "w.com", "tenant": "t", "site": "ext"}),
    site(3, "broken", "greenhouse", greenhouse={"boardToken": "b"}),
    site(4, "nocfg", "lever"),
    site(5, "off", "greenhouse", enabled=False),
    site(6, "walled", "lever", lever={"site": "w"}),
    site(7, "silent", "lever", lever={"site": "s"}),
]
ROLES = [(0, "r0", "sdet", ["SDET"]), (1, "r1", "cloud", ["Cloud Engineer", "sdet"])]
PAYLOADS = [
    payload(1, "acme", "greenhouse", GH),
    payload(2, "lever", "lever", LEVER),
    payload(3, "wd", "workday", {"total": 3, "jobPostings": [{"title": "A", "externalPath": "a"}, {"title": "B", "externalPath": "b"}]}, "sdet", 1),
    payload(4, "wd", "workday", {"total": 3, "jobPostings": [{"title": "C", "externalPath": "c"}]}, "sdet", 2),
    payload(5, "wd", "workday", {"total": 3, "jobPostings": [{"title": "late", "externalPath": "z"}]}, "sdet", 3),
    payload(6, "wd", "workday", {"total": 1, "jobPostings": [{"title": "B2", "externalPath": "b"}]}, "cloud engineer", 1),
    payload(7, "wd", "workday_detail", {"jobPostingInfo": {"title": "Job A", "jobDescription": "<p>Do A</p>", "jobReqId": "R-A"}}, "a"),
    payload(8, "wd", "workday_detail", {}, "b"),
    payload(9, "wd", "workday_detail", "<html>oops", "c"),
    payload(10, "broken", "greenhouse", {"not": "jobs"}),
    payload(11, "off", "greenhouse", GH),
    payload(12, "walled", "lever", "<div class='g-recaptcha'>"),
]


def frames(spark):
    return (
        spark.createDataFrame(SITES, SITE),
        spark.createDataFrame(ROLES, ROLE),
        spark.createDataFrame(PAYLOADS, RAW_PAYLOAD),
    )


def test_collect_end_to_end(spark):
    sites, roles, payloads = frames(spark)
    run = collect(sites, roles, payloads, None, NOW)
    rows = {r.canonicalUrl: r for r in run.store.collect()}
    assert sorted(rows) == [
        "https://boards.greenhouse.io/acme/jobs/101?gh_src=x", "https://boards.greenhouse.io/acme/jobs/102", "https://jobs.lever.co/x/ab",
        "https://w.com/ext/job/a", "https://w.com/ext/job/b",
    ]
    gh = rows["https://boards.greenhouse.io/acme/jobs/101?gh_src=x"]
    assert (gh.company, gh.requisitionId, gh.location, gh.department, gh.requiredYears) == ("Acme", "101", "Remote", "QA", 5)
    assert (gh.descriptionText, gh.postingDate, gh.matchedProfiles, gh.discoveredFrom) == ("Needs 5+ years", "2026-01-01", ["sdet", "cloud"], ["acme"])
    assert json.loads(gh.rawMetadata)["id"] == 101
    assert rows["https://boards.greenhouse.io/acme/jobs/102"].matchedProfiles == []
    lever = rows["https://jobs.lever.co/x/ab"]
    assert (lever.department, lever.employmentType, lever.postingDate) == ("Infra", "Full", "2025-01-01T00:00:00.000Z")
    assert lever.applyUrl == "https://jobs.lever.co/x/ab/apply"
    a, b = rows["https://w.com/ext/job/a"], rows["https://w.com/ext/job/b"]
    assert (a.title, a.requisitionId, a.descriptionText, a.matchedProfiles) == ("Job A", "R-A", "Do A", ["sdet", "cloud"])
    assert (b.title, b.requisitionId, b.descriptionHtml) == ("B2", "b", None)

    s = run.summary.first()
    assert (s.sitesAttempted, s.sitesSucceeded, s.sitesFailed) == (7, 2, 5)
    assert (s.listingsDiscovered, s.jdsExtracted, s.duplicatesRemoved, s.jobsWritten, s.verificationPauses) == (6, 5, 0, 5, 1)
    errors = {e.site: e.message for e in s.errors}
    assert errors["broken"] == 'Greenhouse board "b" returned an unexpected response shape'
    assert errors["nocfg"].startswith('Cannot determine Lever site slug for "nocfg"')
    assert errors["walled"] == 'Verification required fetching Lever site "w": reCAPTCHA detected'
    assert errors["wd"] == 'Workday job detail "t" returned a non-JSON response'
    assert {r.profile: r.n for r in run.totals.collect()} == {"sdet": 3, "cloud": 4}

    # Again with a limit: the store keeps everything, nothing is added.
    later = [(p[0] + 100, *p[1:]) for p in PAYLOADS]
    again = collect(
        sites, roles, spark.createDataFrame(later, RAW_PAYLOAD), run.store, "2026-04-01", store_keys=run.keys, limit=2, site_ids=["acme", "lever"]
    )
    s = again.summary.first()
    assert (s.sitesAttempted, s.jobsWritten, s.duplicatesRemoved) == (2, 5, 2)
    seen = {r.canonicalUrl: (r.discoveredAt, r.lastSeenAt) for r in again.store.collect()}
    assert seen["https://boards.greenhouse.io/acme/jobs/102"] == (NOW, "2026-04-01")
    assert seen["https://jobs.lever.co/x/ab"] == (NOW, NOW)


def test_triage_order_and_messages(spark):
    rows = [
        (1, "greenhouse", "tok", "hcaptcha not json"), (2, "greenhouse", "tok", "nope"), (3, "greenhouse", "tok", '{"jobs":{}}'),
        (4, "greenhouse", "tok", '{"jobs":[]}'), (5, "lever", "s", "{}"), (6, "lever", "s", "[]"), (7, "workday", "t", '{"total":"1","jobPostings":[]}'),
        (8, "workday", "t", '{"total":1,"jobPostings":[]}'), (9, "workday_detail", "t", "{}"), (10, "greenhouse", "tok", "null"),
    ]
    df = spark.createDataFrame(rows, "seq long, source_kind string, ident string, body string")
    got = {r.seq: (r.verdict, r.error) for r in triage_payloads(df).collect()}
    assert [got[i][0] for i in range(1, 11)] == [
        "challenge", "not_json", "bad_shape", "ok", "bad_shape", "ok", "bad_shape", "ok", "ok", "bad_shape",
    ]
    assert got[1][1] == 'Verification required fetching Greenhouse board "tok": hCaptcha detected'
    assert got[7][1] == 'Workday tenant "t" returned an unrecognized response shape'


def test_large_boards_site_order_and_unknown_kinds(spark):
    board = {"jobs": [{"id": i, "title": f"T{i}", "absolute_url": f"https://b.com/{i}", "content": f"text of job {i}"} for i in range(6000)]}
    sites = spark.createDataFrame(SITES[:2], SITE)
    roles = spark.createDataFrame([], ROLE)
    payloads = spark.createDataFrame(
        [payload(10, "lever", "lever", LEVER), payload(11, "acme", "greenhouse", board), payload(12, "lever", "smoke", "{}")], RAW_PAYLOAD
    )
    run = collect(sites, roles, payloads, None, NOW)
    assert run.batch.where("source = 'acme'").count() == 6000
    assert {r.site_id: r.message for r in run.errors.collect()} == {"lever": "No reader for payloads of kind smoke"}
    capped = collect(sites, roles, payloads.where("seq < 12"), None, NOW, max_jobs=5)
    assert {r.source: r.n for r in capped.batch.groupBy("source").agg(F.count("*").alias("n")).collect()} == {"acme": 5, "lever": 1}
    # The first site comes first, although its payload landed last.
    first = collect(sites, roles, payloads.where("seq < 12"), None, NOW, limit=1)
    assert [(r.source, r.seq >> 20) for r in first.batch.collect()] == [("acme", 10)]


def test_too_many_rows_of_a_payload_are_an_error(spark):
    df = spark.range(1).select(position_seq(F.lit(1), F.lit(1 << 20)).alias("seq"))
    with pytest.raises(Exception, match="more than 1048576 rows"):
        df.collect()


def test_generic_sites_from_captured_pages(spark):
    block = dict(
        searchInputSelector="#q", searchButtonSelector="#go", resultCardSelector=".card", jobLinkSelector="a.job", nextButtonSelector=".next",
        titleSelector="h1", locationSelector=".place", descriptionSelector=".text",
    )
    sites = [site(0, "own", "generic", generic=block), site(1, "odd", "generic", generic={**block, "descriptionSelector": "a > b"})]
    roles = [(0, "r0", "sdet", ["SDET"]), (1, "r1", "cloud", ["Cloud"])]
    links = lambda *names: "".join(f"<a class='job' href='/j/{n}'>x</a>" for n in names)
    more = "<a class='next'>more</a>"
    pages = [
        (100, "own", "SDET", 1, "https://own.com/s", links("a", "b") + more),
        (101, "own", "SDET", 2, "https://own.com/s", links("b") + more),  # adds nothing: the last one read
        (102, "own", "SDET", 3, "https://own.com/s", links("never") + more),
        (103, "own", "Cloud", 1, "https://own.com/s", links("b", "c")),
        (104, "own", "Cloud", 2, "https://own.com/s", links("late")),  # nothing led here
        (105, "own", "Other", 1, "https://own.com/s", links("other")),
        (106, "odd", "SDET", 1, "https://odd.com/s", links("z")),
    ]
    detail = "<h1> Role {0} </h1><p class='place'>Rome</p><div class='text'><b>Needs</b> 4 years of {0}</div>"
    details = [(f"https://own.com/j/{n}", detail.format(n)) for n in ("a", "b", "never", "late", "other")]
    run = collect(
        spark.createDataFrame(sites, SITE), spark.createDataFrame(roles, ROLE), spark.createDataFrame([], RAW_PAYLOAD), None, NOW,
        generic_pages=spark.createDataFrame(pages, "seq long, site_id string, keyword string, page_no int, url string, html string"),
        generic_details=spark.createDataFrame(details, "url string, html string"),
    )
    rows = {r.canonicalUrl: r for r in run.store.collect()}
    assert sorted(rows) == ["https://own.com/j/a", "https://own.com/j/b"]
    b = rows["https://own.com/j/b"]
    assert (b.title, b.location, b.requiredYears, b.sourceType, b.company) == ("Role b", "Rome", 4, "generic", "Own")
    assert b.matchedProfiles == ["sdet", "cloud"] and rows["https://own.com/j/a"].matchedProfiles == ["sdet"]
    errors = {r.site_id: r.message for r in run.errors.collect()}
    assert errors == {"odd": 'Site "odd" has a selector that cannot be used: unsupported selector: a > b'}
    s = run.summary.first()
    assert (s.sitesAttempted, s.sitesSucceeded, s.sitesFailed) == (2, 1, 1)


def test_payloads_and_generic_pages_share_one_numbering(spark):
    block = dict(
        searchInputSelector="#q", searchButtonSelector="#go", resultCardSelector=".card", jobLinkSelector="a.job", nextButtonSelector=".next",
        titleSelector="h1", locationSelector=".place", descriptionSelector=".text",
    )
    board = lambda *ids: {"jobs": [{"id": i, "title": f"T{i}", "absolute_url": f"https://b.com/{i}", "content": f"job {i}"} for i in ids]}
    sites = spark.createDataFrame([site(0, "acme", "greenhouse", greenhouse=dict(boardToken="acme")), site(1, "own", "generic", generic=block), site(2, "zed", "greenhouse", greenhouse=dict(boardToken="zed"))], SITE)
    roles = spark.createDataFrame([], ROLE)
    schema = "seq long, site_id string, keyword string, page_no int, url string, html string"

    def run(first, store, keys, now):
        payloads = spark.createDataFrame(
            [payload(first, "zed", "greenhouse", board(7)), payload(first + 10, "acme", "greenhouse", board(1, 2))], RAW_PAYLOAD
        )
        pages = spark.createDataFrame(
            [(first + 1, "own", None, 1, "https://own.com/s", "<a class='job' href='/j/a'>x</a><a class='next'>more</a>"),
             (first + 2, "own", None, 2, "https://own.com/s", "<a class='job' href='/j/b'>x</a>")], schema,
        )
        details = spark.createDataFrame([(f"https://own.com/j/{n}", f"<h1>Role {n}</h1><div class='text'>about {n}</div>") for n in "ab"], "url string, html string")
        return collect(sites, roles, payloads, store, now, store_keys=keys, generic_pages=pages, generic_details=details)

    one = run(10, None, None, NOW)
    order = [(r.source, r.canonicalUrl[-1]) for r in one.store.orderBy("seq").collect()]
    assert order == [("acme", "1"), ("acme", "2"), ("own", "a"), ("own", "b"), ("zed", "7")]
    assert one.store.select("seq").distinct().count() == 5
    assert [r.canonicalUrl[-1] for r in one.batch.orderBy("seq").limit(3).collect()] == ["1", "2", "a"]
    two = run(30, one.store, one.keys, "2026-05-01")
    rows = {r.canonicalUrl[-1]: (r.seq, r.discoveredAt, r.lastSeenAt) for r in two.store.collect()}
    assert rows == {r.canonicalUrl[-1]: (r.seq, NOW, "2026-05-01") for r in one.store.collect()}
    clash = spark.createDataFrame([payload(10, "acme", "greenhouse", board(1))], RAW_PAYLOAD)
    page = spark.createDataFrame([(10, "own", None, 1, "https://own.com/s", "")], schema)
    with pytest.raises(ValueError, match="same numbers"):
        collect(sites, roles, clash, None, NOW, generic_pages=page, generic_details=spark.createDataFrame([], "url string, html string"))
