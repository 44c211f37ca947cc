"""Prefix trie against a trie built turn by turn in plain Python."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalmill.llm import prefix_trie as module
from signalmill.llm.prefix_trie import conversation_trie, digests, node_texts, numbered_turns, op11_prefix_trie, running

SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
])
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def listed(rows):
    """{conv_id: [(role, text)]}, equal turn numbers in order of the digest that the operator sorts by."""
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            out.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    return {c: [x[3:] for x in sorted(turns)] for c, turns in out.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def plain(conversations):
    members, ends = {}, {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {}
    for key in members:
        if key:
            children.setdefault(key[:-1], []).append(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        leaves[key] = sum(leaves[c] for c in children.get(key, [])) or 1
        own = (len(members[key]) - 1) * len(WORD.findall(key[-1][1])) if key else 0
        saved[key] = own + sum(saved[c] for c in children.get(key, []))
    digest = lambda key: hashlib.sha256(",".join(map(str, sorted(ends.get(key, [])))).encode()).hexdigest()
    return sorted(
        ((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children.get(k, [])), leaves[k], saved[k], digest(k)) for k, m in members.items()), key=repr
    )


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_the_query(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(op11_prefix_trie(spark, folder)) == plain(rebuilt(listed(rows)))


@pytest.fixture(scope="module")
def planted():
    """Copies, conversations that stop inside a block, forks at every turn, one of 300 turns that another follows for 100."""
    rng = random.Random(4)
    rows = []
    add = lambda c, texts: rows.extend((c, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts))
    for c in range(0, 60):
        add(c, [f"turn {rng.randint(0, 1)} of {i}" for i in range(rng.randint(1, 11))])
    for c in range(60, 90):
        add(c, ["the same", "in all of them", "to the end"])
    for c in range(90, 100):
        add(c, ["the same", "in all of them", "to the end", "and on", f"own {c}"])
    long = [f"long {i} words" for i in range(300)]
    add(200, long)
    add(7000, long[:100] + ["off"])
    add(123_456, long)
    add(3, [])
    return rows


@pytest.mark.parametrize("block", [1, 4, 7])
def test_planted_conversations(spark, planted, block, monkeypatch):
    monkeypatch.setattr(module, "SLICE", 16)
    monkeypatch.setattr(module, "ID_RUN", 7)
    got = result(conversation_trie(spark.createDataFrame(planted, SCHEMA).repartition(5), block=block))
    assert got == plain(listed(planted))


def test_only_blocks_with_siblings_are_refined(spark, monkeypatch):
    kept = {}
    real = module.written

    def keep(df, label):
        kept[label] = real(df, label)
        return kept[label]

    monkeypatch.setattr(module, "written", keep)
    shared = [f"shared {i}" for i in range(12)]
    rows = [(c, i, "user", t) for c in range(40) for i, t in enumerate(shared + ([f"own {c}"] if c % 2 else []))]
    got = result(conversation_trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == plain(listed(rows))
    inside = kept["trie-inside"]
    # three shared blocks have one representative, whatever the number of conversations; the fork has one per own ending
    assert inside.where("depth <= 12").count() == 12 and inside.where("depth > 12").count() == 20
    assert {r.depth for r in inside.where("NOT forked").collect()} == set(range(5, 13))


def test_a_long_conversation_is_numbered_over_ranges(spark):
    rows = [(1, i // 3, "user", f"t {i % 5}") for i in range(900)] + [(2, None, "user", "x"), (2, 0, "user", "y"), (2, None, "user", "x")]
    turns = numbered_turns(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r["at"] for r in turns if r["conv_id"] == 1) == list(range(900))
    wanted = [hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest() for r, t in listed(rows)[1]]
    assert [bytes(r["digest"]) for r in sorted((r for r in turns if r["conv_id"] == 1), key=lambda r: r["at"])] == wanted


def test_running_sums_over_slices(spark, monkeypatch):
    monkeypatch.setattr(module, "SLICE", 4)
    rows = [(k, i, i * i + 1) for k in range(3) for i in range(11 * k + 1)]
    df = spark.createDataFrame(rows, "k long, i long, v long")
    for back in (False, True):
        got = running(df, "k", "i", {"s": F.col("v")}, F.sum, lambda a, b: a + b, 0, back=back).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r["s"] == sum(v for k, i, v in rows if k == r["k"] and (i >= r["i"] if back else i <= r["i"]))


def test_digests_of_many_runs(spark):
    df = spark.createDataFrame([(k, r, f"{10 * r},{10 * r + 1}") for k in range(9) for r in range(40)], "k long, r long, ids string")
    wanted = hashlib.sha256(",".join(f"{10 * r},{10 * r + 1}" for r in range(40)).encode()).hexdigest()
    assert sorted(map(tuple, digests(df.repartition(7), ["k"], "r", "ids").collect())) == [(k, wanted) for k in range(9)]


def test_texts_of_nodes(spark, planted):
    df = spark.createDataFrame(planted, SCHEMA)
    nodes = conversation_trie(df)
    texts = {(r.conv_id, r.depth): (r.role, r.text) for r in node_texts(nodes, df).collect()}
    own = listed(planted)
    assert len(texts) == nodes.count() - 1
    assert all(texts[c, d] == own[c][d - 1] for c, d in texts)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [
        (1, None, None, None), (1, None, "user", "a"), (1, 0, "", ""), (1, 0, None, None), (2, 5, "user", long), (2, 5, "user", long), (3, 1, "user", long),
        (None, 1, "user", "lost"), (-7, 0, "user", long), (20, 0, "user", " \n"), (21, 0, "system", "x y"), (21, 0, "system", "x y"), (25, 3, "user", "z"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    wide = df.withColumn("at", F.lit("x")).withColumn("words", F.lit(1)).withColumn("block", F.lit(None))
    assert result(conversation_trie(wide)) == plain(listed(rows))
    assert result(module.prefix_trie(*module.rebuilt_turns(numbered_turns(df.where("conv_id >= 0"))))) == plain(rebuilt(listed([r for r in rows if r[0] is None or r[0] >= 0])))
    assert conversation_trie(df.limit(0)).collect() == []
