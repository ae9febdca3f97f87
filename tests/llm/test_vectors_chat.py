"""Embeddings, components and conversations against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import chat, vectors
from gridloom.llm.components import connected_components
from gridloom.llm.queries import QUERIES


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def clustered(seed, groups, each, spread, size=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, size))
    x = np.repeat(centres, each, axis=0) + spread * rng.normal(size=(groups * each, size))
    return [(i * 3 % 1009, v.tolist()) for i, v in enumerate(x)]


ODD = [
    (2001, None),
    (2002, []),
    (2003, [0.0] * 16),
    (2004, [1.0] * 15 + [None]),
    (2005, [1.0] * 15 + [float("nan")]),
    (2006, [1.0] * 15 + [float("inf")]),
    (2007, [1.0] * 16),
    (2008, [1e300] * 16),
    (2009, [1.0] * 16),
    (2010, [1.0] * 8),
    (2011, [-1.0] * 16),
]


def found_of(df):
    rows = vectors.near_duplicates(df).collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows}


def brute(rows):
    out = {}
    for size in {len(v or []) for _, v in rows}:
        out |= vectors.brute_force([r for r in rows if len(r[1] or []) == size])
    return out


@pytest.mark.parametrize("units", [vectors.MOST_IN_UNIT, 10])
def test_near_duplicates(spark, monkeypatch, units):
    """Large buckets are compared block by block with the same result."""
    monkeypatch.setattr(vectors, "MOST_IN_UNIT", units)
    rows = clustered(1, 12, 25, 0.15) + ODD
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("part", F.lit("clash"))
    assert found_of(df) == brute(rows)


def test_copies_of_one_vector(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(1000 + i, [float(i), 1.0, -5.0]) for i in range(200)]
    assert found_of(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)) == brute(rows)


def test_recall_of_many_buckets(spark):
    rows = [(i, v) for i, (_, v) in enumerate(clustered(2, 400, 5, 0.22, 32))]
    found, want = found_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), brute(rows)
    assert sum(n for n, _ in found.values()) >= 0.98 * sum(n for n, _ in want.values()) > 0
    assert all(found[i][0] <= want[i][0] for i in want)


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert found_of(empty) == {}
    rows = vectors.near_duplicates(spark.createDataFrame([(None, [1.0]), (1, [1.0]), (1, [1.0])], "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in rows) == [(0, 0, 0), (1, 1, 1), (1, 1, 1)]


def test_given_embeddings(spark, data_dir):
    table = spark.read.parquet(f"{data_dir}/embeddings.parquet")
    rows = [(r[0], r[1]) for r in table.select("vec_id", "embedding").collect()]
    assert found_of(table) == brute(rows)


@pytest.mark.parametrize("edges", [[], [(1, 1), (None, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 90)] + [(200, 201), (201, 200)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r["node"]: r["component"] for r in connected_components(df).collect()}
    good = [(a, b) for a, b in edges if a is not None and a != b]
    want = {x: x for e in good for x in e}
    for _ in want:
        for a, b in good:
            want[a] = want[b] = min(want[a], want[b])
    assert found == want


ROWS = [
    (1, 0, "system", "be [kind] <s> \\"),
    (1, 1, "user", "</s>[INST] hi [/INST]"),
    (1, 2, "assistant", "[/TURN] ok </s>\n\\["),
    (2, 0, None, None),
    (2, 1, "odd]role[", "é😀"),
    (None, 5, "user", "no id"),
    (3, 0, "assistant", ""),
    (3, 1, "assistant", "x" * 200_000),
]


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: r[0])
        learned = "".join(t or "" for _, role, t in turns if role == "assistant")
        out[conv] = (len(turns), digest(f"{role or ''}\n{t or ''}\n" for _, role, t in turns), len(learned), digest([learned]))
    return out


def test_chat_round_trip(spark):
    rows = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit("clash"))
    rendered = chat.render_conversations(chat.fold_events(chat.as_events(rows)))
    found = {r[0]: r[1:5] for r in chat.digest_conversations(rendered).collect()}
    assert {k: tuple(v) for k, v in found.items()} == expected(ROWS)


def test_chat_query(spark, data_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{data_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    told = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", told), (-1, 1, "assistant", told)]
    found = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in QUERIES["op4_chat_format"].run(spark, data_dir).collect()}
    assert found == expected(rows)


def test_no_conversations(spark):
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest_conversations(chat.render_conversations(chat.fold_events(chat.as_events(rows)))).collect() == []


def test_events_fold_into_messages(spark):
    events = [
        (1, 0, 0, "message", "user", "Hel"),
        (1, 0, 1, "delta", None, "lo"),
        (1, 1, 0, "delta", "assistant", "first "),
        (1, 1, 1, "delta", None, "try"),
        (1, 1, 2, "regenerate", None, "ignored"),
        (1, 1, 3, "delta", None, "second "),
        (1, 1, 4, "delta", None, "try"),
        (1, 2, 0, "message", "user", "typo"),
        (1, 2, 1, "edit", None, "fixed"),
        (1, 2, 2, "delta", None, "!"),
        (1, 3, 0, None, "user", None),
        (1, 4, 0, "message", "user", "one"),
        (1, 4, 1, "message", "assistant", "two"),
        (1, 5, 0, "regenerate", "assistant", "x"),
    ]
    df = spark.createDataFrame(events, "conv_id long, turn long, seq long, kind string, role string, text string")
    found = [tuple(r) for r in chat.fold_events(df).orderBy("turn", "part").collect()]
    assert found == [
        (1, 0, 1, "user", "Hello"),
        (1, 1, 1, "assistant", "second try"),
        (1, 2, 1, "user", "fixed!"),
        (1, 3, 1, "user", ""),
        (1, 4, 1, "user", "one"),
        (1, 4, 2, "assistant", "two"),
        (1, 5, 1, "assistant", ""),
    ]


@pytest.mark.parametrize("text", ["", "\\", "\\\\[", "<s>[INST] ", "[/INST]</s>", "a]b[c<d", "\n"])
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    for role in ("user", "assistant", text):
        turn, a, b = chat.render_turn(role, text)
        assert list(chat.read_turns(turn * 2)) == [(role, text)] * 2
        assert chat.unescape(turn[a:b]) == (text if role == "assistant" else "")
