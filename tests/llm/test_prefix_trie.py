"""The prefix trie against one built turn by turn."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from postloom.llm import prefix_trie, queries
from tests.llm.helpers import DATA, HAVE_DATA

SCHEMA = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_trie(rows, splice):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: x[:2])] for c, v in convs.items()}
    if splice:
        heads = {c: zlib.crc32(str(c).encode()) % 4 for c in convs}
        convs = {c: convs.get(c - c % 20, [])[: heads[c]] + v[heads[c] :] for c, v in convs.items()}
    members = {}
    for c, v in convs.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    out = []
    for node, who in members.items():
        below = [n for n in members if n[: len(node)] == node]
        inner = {n[:-1] for n in below if n}
        ends = sorted(c for c in who if len(convs[c]) == len(node))
        out.append(
            (
                min(who),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(who),
                sum(1 for n in members if n and n[:-1] == node),
                sum(1 for n in below if n not in inner),
                sum((len(members[n]) - 1) * len(WORD.findall(n[-1][1])) for n in below if n),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"'x' as {c}" for c in "key pos run total".split()])


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("splice", [False, True])
def test_random(spark, seed, splice, monkeypatch):
    # Small parts: conversations, copies and nodes are spread over several tasks.
    monkeypatch.setattr(prefix_trie, "ROWS_PER_PART", 40)
    monkeypatch.setattr(prefix_trie, "IDS_PER_CHUNK", 3)
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(100), 45):
        for t in range(rng.choice([1, 2, 3, 5, 9])):
            text = rng.choice(["a b", "a  b c", "", "déjà vu"]) if t < 6 else "tail"
            rows.append((c, None if t == 0 and c % 7 == 0 else t, rng.choice(["user", None]), text))
    rng.shuffle(rows)
    got = found(prefix_trie.prefix_trie(made(spark, rows), splice))
    assert got == brute_trie(rows, splice)


def test_long_and_common(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ROWS_PER_PART", 50)
    monkeypatch.setattr(prefix_trie, "IDS_PER_CHUNK", 4)
    same = [(c, t, "user", f"word {t}") for c in range(20) for t in range(4)]
    long = [(c, t, "user", f"word {min(t, 150)}") for c in (30, 31) for t in range(200)]
    rows = same + long + [(31, 200, "user", "x")]
    assert found(prefix_trie.prefix_trie(made(spark, rows))) == brute_trie(rows, False)


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "lost"),
        (1, 0, None, None),
        (2, 0, "", ""),
        (3, None, "user", "  x\x1c y"),
        (3, 5, "user", "long " * 50_000),
        (3, 5, "user", "long " * 50_000),
        (0, 0, "us", "er"),
        (4, 0, "user", ""),
    ]
    for splice in (False, True):
        assert found(prefix_trie.prefix_trie(made(spark, rows), splice)) == brute_trie(rows, splice)
    assert found(prefix_trie.prefix_trie(made(spark, []))) == []


def test_turnless(spark):
    # Conversation 20 * k is absent, so the followers lose their first turns for nothing.
    rows = [(c, 0, "user", f"t{c}") for c in range(1, 20)]
    got = found(prefix_trie.prefix_trie(made(spark, rows), True))
    assert got == brute_trie(rows, True)
    assert [r for r in got if r[1] == 0][0][7] != hashlib.sha256(b"").hexdigest()


@pytest.mark.skipif(not HAVE_DATA, reason="test tables not present")
def test_whole_table(spark):
    table = queries.table(spark, DATA, "conversations")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table.collect()]
    df = queries.QUERIES["op12_prefix_trie"](spark, DATA)
    assert df.columns[:3] == ["conv_id", "depth", "parent_conv_id"]
    assert found(df) == brute_trie(rows, True)
