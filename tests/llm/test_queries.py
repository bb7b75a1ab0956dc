"""Registered queries: contract columns, SQL where there is any, and the pipeline by stages."""

import hashlib
import re

import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from postloom.llm import bpe, mixing, quality, queries, simhash
from postloom.session import cut
from tests.llm.helpers import DATA, HAVE_DATA
from tests.llm.test_near_copies import brute_kept

pytestmark = pytest.mark.skipif(not HAVE_DATA, reason="test tables not present")

COLUMNS = {
    "op2": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op3": "page_id url text n_chars",
    "op4": "doc_id size source_size target taken",
    "op5": "query_id rank vec_id score",
    "op6": "page_id host path rule verdict",
    "op7": "doc_id fingerprint component_id",
    "op8": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op9": "query_id rank vec_id score",
    "op10": "doc_id held_out score predicted",
    "op11": "item_id rank doc_id score",
    "op12": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    "op13": "doc_id n_shingles component_id",
}


def by_number(number):
    return next(q for q in queries.QUERIES if q.startswith(f"{number}_"))


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.QUERIES}
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("number", COLUMNS)
def test_contract_columns(spark, number):
    df = queries.QUERIES[by_number(number)](spark, DATA)
    assert df.columns[: len(COLUMNS[number].split())] == COLUMNS[number].split() or set(
        COLUMNS[number].split()
    ) <= set(df.columns)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)

    def plain(value):
        return round(value, 6) if isinstance(value, float) else value

    found = con.execute(queries.SQL[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == columns
    want = sorted((tuple(plain(r[at.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want


@pytest.fixture(scope="module")
def library():
    with open(queries.RANK_FILE, "rb") as file:
        tokens = bpe.read_ranks(file.read())
    return tiktoken.Encoding(
        "own", pat_str=bpe.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={}
    )


def digests(text, library):
    ids = library.encode_ordinary(text or "")
    decoded = library.decode_bytes(ids)
    return len(ids), *(hashlib.sha256(b).hexdigest() for b in (" ".join(map(str, ids)).encode(), decoded))


def test_tokens_of_the_whole_table(spark, library):
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, DATA, "documents").collect()}
    rows = queries.QUERIES[by_number("op2")](spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1:] == digests(texts[r["doc_id"]], library)
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_pages_of_the_whole_table(spark):
    from html import unescape

    pages = {r["page_id"]: r for r in queries.table(spark, DATA, "pages").collect()}
    rows = queries.QUERIES[by_number("op3")](spark, DATA).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r["page_id"]]["html"], re.DOTALL)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])
        assert r["url"] == pages[r["page_id"]]["url"]


def test_pipeline_stage_by_stage(spark, library):
    docs = queries.table(spark, DATA, "documents")
    labels = {r["doc_id"]: r for r in queries.table(spark, DATA, "labels").collect()}
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(cut(stage(spark, steps[-1], DATA), "test-stage"))
    assert all(s.columns == docs.columns for s in steps[1:-1])
    ids = [sorted(r["doc_id"] for r in s.collect()) for s in steps]

    # Quality: labels agree with what goes and what stays.
    known = [(labels[i]["quality"], i in ids[1]) for i in ids[0] if i in labels]
    assert sum(q == k for q, k in known) >= 0.95 * len(known)
    model = quality.train(docs, queries.table(spark, DATA, "labels"))
    scores = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, model).collect()}
    assert ids[1] == sorted(i for i in ids[0] if scores[i] >= quality.CUT)
    # Toxicity: hardly any clean document goes.
    known = [(labels[i]["toxic"], i in ids[2]) for i in ids[1] if i in labels]
    assert sum(1 for t, k in known if not t and not k) <= 0.01 * len(known)
    # Near duplicates, by comparing all pairs.
    texts = {r["doc_id"]: r["text"] for r in steps[2].collect()}
    assert ids[3] == brute_kept(texts)
    # Mixing: as often as the operator says.
    copies = {r["doc_id"]: r["copies"] for r in mixing.pareto_mix(steps[3]).collect()}
    assert ids[4] == sorted(i for i, n in copies.items() for _ in range(n))
    # Tokens, by the library; and the whole run gives the same rows.
    want = sorted((i, *digests(texts[i], library)) for i in ids[4])
    assert sorted(map(tuple, steps[5].collect())) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == want


def test_stages_without_labels_keep_documents(spark, folder):
    docs = queries.table(spark, DATA, "documents").where(F.col("doc_id") < 20)
    queries.table(spark, DATA, "labels").where("false").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.quality_stage(spark, docs, folder).count() == docs.count()
    assert corpus_pipeline.toxicity_stage(spark, docs, folder).count() == docs.count()
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
    assert simhash.MAX_DISTANCE == 3
