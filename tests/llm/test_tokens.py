"""Collocations, packing and token alignment against brute force, on hand-made cases and on whole given tables."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gridloom.llm import alignment, collocations, packing, tokens

PATTERN = public_tokenizers.PATTERN
FILE_A = tokens.read_file(public_tokenizers.path("byte_bpe_50k.json"))
FILE_B = tokens.read_file(public_tokenizers.path("piece_bpe_32k.model"))
RANDOM = random.Random(11)


def words(n, most=40):
    return " ".join(RANDOM.choices(["a", "B", "été", "of", "the", "x,", "y.", "|", "z\t", "é", " ", *map(str, range(most))], k=n))


TEXTS = [
    None,
    "",
    " ",
    "\n\t ,;",
    "one",
    "Great deal, great deal; great\tdeal",
    *["great deal of tea. New York! new york: NEW YORK\x0bnew york\r"] * 14,
    *(words(n) for n in (1, 2, 3, 60, 400, 3000)),
    "<|endoftext|> </s> [INST] <unk>",
    "▁ in it",
    "é😀\x00 ﬁ   x",
    "q" * 30_000,
    " " * 5_000 + "end",
    words(30_000, 3000),
]
LANGS = [None, "en", "de", "", "en"]


@pytest.fixture(scope="module")
def small(spark):
    rows = [(i if i % 9 else None, t, LANGS[i % 5], f"s{i % 3}" if i % 4 else None, i) for i, t in enumerate(TEXTS)]
    rows += [rows[10]] * 3
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _n int")


@pytest.fixture(scope="module")
def given(spark, data_dir):
    documents = spark.read.parquet(f"{data_dir}/documents.parquet")
    return [tuple(r) for r in documents.select("doc_id", "text", "lang", "source").collect()], documents


@pytest.fixture(params=["small", "given"])
def either(request):
    return request.getfixturevalue(request.param)


@pytest.mark.parametrize("blocks", [collocations.BLOCK_BYTES, 20_000])
def test_collocations(either, monkeypatch, blocks):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", blocks)
    monkeypatch.setattr(collocations, "BUCKET_BYTES", blocks)
    rows, df = either
    found = sorted(map(tuple, collocations.collocations(df).collect()))
    assert found == sorted(collocations.brute_force([(r[2], r[1]) for r in rows]))
    assert found


@pytest.mark.parametrize("most_words, shards", [(2, 1), (4, 3)])
def test_other_sizes(small, most_words, shards):
    rows, df = small
    found = collocations.collocations(df, support=5, most_words=most_words, shards=shards, top=30)
    assert sorted(map(tuple, found.collect())) == sorted(collocations.brute_force([(r[2], r[1]) for r in rows], 5, most_words, 30))


def test_shards_miss_nothing_at_the_border(spark):
    rows = [(i, f"rare pair{i % 30}", "en") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert collocations.collocations(df).count() == 30  # each stands exactly 10 times, dealt over four shards


def test_large_counts_are_exact(spark):
    big = 10**14
    rows = [("x", "a b", 2, big - 1), ("x", "a", 1, big), ("x", "b", 1, big + 7)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, size int, f long")
    (row,) = collocations.score_phrases(counts, counts.filter("size = 2")).collect()
    assert row["score"] == 1_000_000 * (big - 1) ** 2 // (big * (big + 7))


def test_many_distinct_words_in_a_block():
    block = collocations.Block.__new__(collocations.Block)
    block.words = [b"w"] * 3_000_000  # three of these numbers no longer fit one key
    block.ids = np.array([5, 6, 2_999_999, 5, 6, 2_999_999, 7], np.int32)
    block.lang = np.zeros(7, np.int32)
    _, _, counts = block.phrases(3, np.array([0, 1, 3]))
    assert sorted(counts.tolist()) == [1, 2]


def encoded(text):
    plain = tokens.ByteBpe(FILE_A, PATTERN).plain
    return [*plain.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.fixture(scope="module")
def plain():
    return tokens.ByteBpe.of(FILE_A, PATTERN)


def test_encoder_agrees_with_its_library(plain):
    for text in TEXTS:
        if text:
            assert plain.encode(text) == plain.plain.encode(text, add_special_tokens=False).ids
    for _ in range(200):
        text = "".join(chr(RANDOM.choice([RANDOM.randrange(32, 127), RANDOM.randrange(0x250), RANDOM.randrange(0xD800)])) for _ in range(80))
        assert plain.encode(text) == plain.plain.encode(text, add_special_tokens=False).ids
    assert plain.encode(" " * 2_000_000 + "x")


def packed_texts(rows, plain):
    return [[*(plain.plain.encode(r[1], add_special_tokens=False).ids if r[1] else []), 1] for r in rows]


@pytest.mark.parametrize("options", [{}, {"part_tokens": 9_000}, {"length": 64, "quantum": 1, "shares": {"s1": 0.7, "src0": 0.2}}])
def test_packing_is_a_partition_of_all_ids(either, plain, options):
    rows, df = either
    length = options.get("length", packing.LENGTH)
    found = packing.pack(df, FILE_A, PATTERN, keep=("doc_id", "source"), **options).collect()
    by_sequence, by_doc = {}, {}
    for r in found:
        assert r["length"] == len(r["ids"]) > 0
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault((r["doc_id"], r["source"], r["doc_tokens"]), []).append(r)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == length or at < length and at & (at - 1) == 0
    wanted = {}
    for r, ids in zip(rows, packed_texts(rows, plain)):
        wanted.setdefault((r[0], r[3], len(ids)), []).append(ids)
    assert set(by_doc) == set(wanted)
    for key, members in by_doc.items():
        if len(wanted[key]) == 1:
            members.sort(key=lambda r: r["start"])
            assert [i for r in members for i in r["ids"]] == wanted[key][0]
            assert [r["start"] for r in members] == np.cumsum([0, *(r["length"] for r in members)])[:-1].tolist()
        else:
            assert sorted(i for r in members for i in r["ids"]) == sorted(i for ids in wanted[key] for i in ids)


def test_windows_hold_the_target_shares(spark):
    text = "all of the words here are plain and short " * 12
    rows = [(i, text, "big" if i % 10 < 6 else "mid" if i % 10 < 9 else "small") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = packing.pack(df, FILE_A, PATTERN, keep=("source",), part_tokens=50_000, with_ids=False)
    shares = found.groupBy("sequence_id", "source").agg(F.sum("length").alias("n")).collect()
    sizes = {}
    for r in shares:
        sizes[r["sequence_id"]] = sizes.get(r["sequence_id"], 0) + r["n"]
    whole = [r for r in shares if r["source"] == "big" and sizes[r["sequence_id"]] == packing.LENGTH]
    near = [r for r in whole if abs(r["n"] - 0.6 * packing.LENGTH) <= 2 * packing.QUANTUM]
    assert len(near) >= 0.9 * len(whole) > 80  # but for the last windows of the parts
    running = {}
    for r in found.groupBy("sequence_id", "source").agg(F.sum("length").alias("n")).orderBy("sequence_id").collect():
        running[r["source"]] = running.get(r["source"], 0) + r["n"]
    assert abs(running["big"] / sum(running.values()) - 0.6) < 0.01


def test_deficits_are_carried():
    served = packing.fill_windows(np.array([30.0, -30.0]), np.array([0.5, 0.5]), np.array([500, 500]), [100] * 10, 1)
    first = {s: n for w, s, n in served if w == 0}
    assert first == {0: 80, 1: 20}
    assert sum(n for *_, n in served) == 1000


def test_running_totals_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 3)
    rows = [(p, s, (p * 7 + len(s)) % 11 + 1) for p in range(20) for s in ("a", "bb", "c") if (p + len(s)) % 3]
    total = sum(n for *_, n in rows)
    found = packing._running(spark.createDataFrame(rows, "_part int, _source string, n long"), None).collect()
    assert len(found) == len(rows)
    for r in found:
        share = sum(n for _, s, n in rows if s == r["_source"]) / total
        owed = share * sum(n for p, _, n in rows if p < r["_part"]) - sum(n for p, s, n in rows if p < r["_part"] and s == r["_source"])
        assert r["owed"] == pytest.approx(owed) and r["share"] == pytest.approx(share)


ALIGNED = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")


@pytest.mark.parametrize("block_bytes", [alignment.BLOCK_BYTES, 3_000])
def test_alignment(spark, plain, given, block_bytes):
    texts = [t if t is None else t[:1500] for t in TEXTS] + [r[1][:700] for r in given[0][:60]]
    rows = [(i, t, 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pair int")
    found = {r["doc_id"]: tuple(r[c] for c in ALIGNED) for r in alignment.align_documents(df, FILE_A, PATTERN, FILE_B, block_bytes=block_bytes).collect()}
    other = tokens.PieceBpe.of(FILE_B)
    encode = lambda t: plain.plain.encode(t, add_special_tokens=False).ids
    wanted = alignment.brute_force(texts, encode, other.encode, plain.token_bytes, other.token_bytes)
    assert [found[i] for i in range(len(texts))] == wanted


def test_alignment_of_whole_tables(given, plain):
    rows, df = given
    found = {r["doc_id"]: r for r in alignment.align_documents(df, FILE_A, PATTERN, FILE_B).collect()}
    assert len(found) == len(rows)
    other = tokens.PieceBpe.of(FILE_B)
    for doc_id, text, *_ in rows:
        r = found[doc_id]
        if r["n_a"]:
            assert r["n_a"] == len(plain.encode(" " + text)) and r["n_b"] == len(other.encode(text))
            assert r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"]  # each step but a cut advances one pointer


def test_lanes_change_nothing():
    sizes = [np.array([1, 3, 2, 1, 1, 4, 2, 2, 1, 3]), np.array([4, 4, 2, 2, 8])]
    ends = [np.cumsum(s) for s in sizes]
    offsets = np.array([0, 0, 10, 10]), np.array([0, 0, 5, 5])
    results = []
    for lane in (1, 3, 4, 256):
        a, b, cut_a, cut_b = alignment.lockstep(*ends, *offsets, lane=lane)
        results.append((sorted(zip(a.tolist(), b.tolist())), cut_a.tolist(), cut_b.tolist()))
    assert all(r == results[0] for r in results)


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert collocations.collocations(none).collect() == []
    assert packing.pack(none, FILE_A, PATTERN).collect() == []
    assert alignment.align_documents(none, FILE_A, PATTERN, FILE_B).collect() == []


def test_clashing_columns(spark):
    rows = [(1, "tea and tea", "en", "s", 5, 6, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, length int, _n int, n_a int")
    assert packing.pack(df, FILE_A, PATTERN, keep=("doc_id", "_n", "text")).first()["_n"] == 6
    assert alignment.align_documents(df, FILE_A, PATTERN, FILE_B, keep=("doc_id", "_n", "n_a")).first()["n_a"] == 3
    assert collocations.collocations(df, support=1).count()
