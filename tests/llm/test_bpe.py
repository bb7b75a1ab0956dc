import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from postloom import session
from postloom.llm import bpe
from tests.llm.helpers import ODD_TEXTS, documents


@pytest.fixture(scope="module")
def ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return file.read()


@pytest.fixture(scope="module")
def vocabulary(ranks):
    return bpe.Vocabulary(bpe.read_ranks(ranks))


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding(
        "own", pat_str=bpe.PATTERN, mergeable_ranks=vocabulary.rank, special_tokens={}
    )


def test_pattern_is_the_public_one():
    assert bpe.PATTERN == public_tokenizers.PATTERN


def test_pieces_agree_with_the_library(vocabulary, library):
    draw = random.Random(4)
    letters = "abe  \n\t'sTHe012éßñ漢😀!!##--   "
    for _ in range(4000):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 30)))
        pieces = bpe.regex.findall(bpe.PATTERN, text)
        ids = [i for p in pieces for i in vocabulary.encode(p.encode())]
        assert ids == library.encode_ordinary(text)
        assert vocabulary.decode(ids) == text.encode()


def test_random_bytes(vocabulary, library):
    draw = random.Random(5)
    for _ in range(500):
        data = bytes(draw.randrange(256) for _ in range(draw.randint(1, 12)))
        assert vocabulary.encode(data) == library._core_bpe.encode_single_piece(data)


def test_appending_equals_encoding_the_whole(vocabulary):
    text = " of the internationalisation of tokenisation" * 3
    parts = bpe.EditableEncoding(vocabulary)
    for i in range(0, len(text), 7):
        parts.append(text[i : i + 7].encode())
    assert parts.ids() == vocabulary.encode(text.encode())
    assert parts.computed == len(text.encode())


def test_edits_equal_encoding_anew_and_stay_local(vocabulary):
    draw = random.Random(6)
    data = "".join(draw.choice("theanding of ") for _ in range(3000)).encode()
    edited = bpe.EditableEncoding(vocabulary, data)
    for _ in range(40):
        start = draw.randrange(len(data))
        end = min(len(data), start + draw.randrange(6))
        new = bytes(draw.choice(b"xyz the") for _ in range(draw.randrange(5)))
        before = edited.computed
        edited.replace(start, end, new)
        data = data[:start] + new + data[end:]
        assert edited.data == data
        assert edited.computed - before < 600
    assert edited.ids() == vocabulary.encode(data)


def test_documents_of_all_kinds(spark, ranks, vocabulary, library):
    df = documents(spark, ODD_TEXTS).repartition(3)
    rows = {r["doc_id"]: r for r in bpe.encode_documents(df, ranks).collect()}
    assert len(rows) == len(ODD_TEXTS)
    for i, text in enumerate(ODD_TEXTS):
        assert bytes(rows[i]["decoded"]) == (text or "").encode()
        if len(text or "") < 150_000:
            assert rows[i]["ids"] == library.encode_ordinary(text or "")
        assert vocabulary.decode(rows[i]["ids"]) == (text or "").encode()


def test_nulls_and_empty_table(spark, ranks):
    df = documents(spark, ["a", "a"], ids=[None, None])
    assert [r["ids"] for r in bpe.encode_documents(df, ranks).collect()] == [[64], [64]]
    assert bpe.encode_documents(df.where("false"), ranks).collect() == []


def test_caches_stay_within_their_bounds_and_keep_what_is_asked_for(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 50)
    cache = bpe.PieceCache(vocabulary)
    computed, encode = [], cache.encode
    cache.encode = lambda piece: computed.append(piece) or encode(piece)
    for k in range(2_000):
        for piece in (" often", f" rare{k}"):
            assert np.frombuffer(cache[piece], "<i4").tolist() == library.encode_ordinary(piece)
        assert len(cache) + len(cache.older) <= 100
    assert computed.count(" often") == 1 and len(computed) == 2_001
    assert bpe.CACHED_PREFIXES <= 300_000 and bpe.CACHED_PAIRS <= 400_000


def test_batches_of_texts_are_small(spark, vocabulary):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    for own, want in (("10000", "2000"), ("0", "2000"), ("7", "7")):
        spark.conf.set(key, own)
        session.small_batches(spark)
        assert spark.conf.get(key) == want
    spark.conf.set(key, before)


def test_batches_of_texts_are_small_in_bytes_as_well(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    df = spark.range(4_000, numPartitions=1).selectExpr("repeat('x', 2000) as text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    try:
        for own, want in (("64m", str(1 << 20)), ("300k", "300k")):
            spark.conf.set(key, own)
            session.small_batches(spark)
            assert spark.conf.get(key) == want
            assert max(r["size"] for r in df.mapInArrow(sizes, "size long").collect()) < 1.2 * (1 << 20)
    finally:
        spark.conf.set(key, before)


def test_other_operators_drop_the_cache_of_a_worker(ranks):
    kept = bpe._cache(ranks)
    assert bpe._cache(ranks) is kept
    bpe.forget()
    assert not bpe._kept and bpe._cache(ranks) is not kept
    bpe.forget()


@pytest.mark.parametrize("slots", [None, 16])
def test_many_strings_at_once_agree_with_the_library(vocabulary, library, monkeypatch, slots):
    if slots:  # next to nothing is remembered
        monkeypatch.setattr(bpe, "STEP_SLOTS", slots)
        monkeypatch.setattr(bpe, "PAIR_SLOTS", slots)
    draw = random.Random(7)
    syllables = " the and ing tion er ß é 漢 😀 ' 12 \n".split(" ")
    many = bpe.ManyStrings(vocabulary)
    assert many.encode([]) == [] and many.encode([b""]) == [b""]
    for n in (1, 400):
        strings = [bytes(draw.randrange(256) for _ in range(draw.randint(1, 64))) for _ in range(n)]
        strings += [(" " + "".join(draw.choices(syllables, k=draw.randint(1, 9)))).encode() for _ in range(n)]
        strings += [b"", b"a", b"a", *draw.choices(vocabulary.tokens, k=n)]
        want = [library._core_bpe.encode_single_piece(s) if s else [] for s in strings]
        assert [np.frombuffer(packed, "<i4").tolist() for packed in many.encode(strings)] == want


def test_new_pieces_of_a_batch_are_encoded_together(vocabulary, library, monkeypatch):
    cache = bpe.PieceCache(vocabulary)
    alone, together, encode = [], [], bpe.ManyStrings.encode
    monkeypatch.setattr(bpe.Vocabulary, "encode", lambda self, data: alone.append(data))
    monkeypatch.setattr(bpe.ManyStrings, "encode", lambda self, strings: together.append(len(strings)) or encode(self, strings))
    pieces = {f" word{k}é" for k in range(3_000)} | {"漢" * 64, "x" * 500}
    for left in (3_000, 0):
        found = cache.all(pieces)
        assert {p: np.frombuffer(ids, "<i4").tolist() for p, ids in found.items()} == {p: library.encode_ordinary(p) for p in pieces}
        assert together.pop() == left and not together and not alone


def test_pieces_of_batches_stay_within_the_bounds(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 50)
    cache = bpe.PieceCache(vocabulary)
    for k in range(0, 900, 90):
        pieces = [" often", *(f" rare{k + i}" for i in range(90))]
        found = cache.all(pieces)
        assert list(map(vocabulary.decode, (np.frombuffer(found[p], "<i4").tolist() for p in pieces))) == [p.encode() for p in pieces]
        assert len(cache) <= 50 and len(cache.older) <= 50
