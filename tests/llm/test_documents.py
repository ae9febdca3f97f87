"""Operators on documents against brute force, on hand-made cases and on whole given tables."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from gridloom.llm import bpe, contamination, languages, licences, quality, repeats, similarity, substrings, suffixes
from gridloom.llm.queries import QUERIES

RANDOM = random.Random(5)
WORDS = ["".join(RANDOM.choices("abcdeéïß", k=RANDOM.randint(1, 9))) for _ in range(900)]


def prose(n, seed=None):
    source = RANDOM if seed is None else random.Random(seed)
    return " ".join(source.choices(WORDS, k=n))


PASSAGE = prose(80, 1)
TEXTS = [
    None,
    "",
    "   \t\n ",
    "one",
    "two words",
    PASSAGE,
    PASSAGE,
    prose(30) + " " + PASSAGE + "  " + prose(20),
    PASSAGE.replace(" ", "\n"),
    prose(49),
    prose(50, 2),
    prose(50, 2),
    prose(50, 2) + " tail",
    " ".join(["again"] * 300),
    " ".join(["again"] * 120),
    PASSAGE + " " + PASSAGE,
    "x" * 20_000,
    "x" * 20_000,
    prose(9_000, 3),
    prose(20) + " " + prose(9_000, 3),
    "ab" * 70 + "é" * 60,
    "é" * 60 + "ba" * 70,
    "Licensed under the Apache License, Version 2.0.\nAll  rights\treserved.",
    "\x00\x1f '   😀 <|endoftext|> 's",
]


@pytest.fixture(scope="module")
def small(spark):
    rows = [(i * 7 % 101 + (i > 12) * 1000, t) for i, t in enumerate(TEXTS)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def given(spark, data_dir):
    documents = spark.read.parquet(f"{data_dir}/documents.parquet")
    return [tuple(r) for r in documents.select("doc_id", "text").collect()], documents


@pytest.fixture(params=["small", "given"])
def either(request):
    return request.getfixturevalue(request.param)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_repeated_words(either):
    rows, df = either
    found = by_id(substrings.remove_repeated_words(df), "n_words", "n_removed", "kept")
    assert found == {d: x for (d, _), x in zip(rows, substrings.brute_force(rows))}


def test_repeated_bytes(either):
    rows, df = either
    found = by_id(suffixes.remove_repeated_bytes(df), "n_bytes", "n_removed", "n_spans", "kept")
    assert {d: (*x[:3], bytes(x[3])) for d, x in found.items()} == {d: x for (d, _), x in zip(rows, suffixes.brute_force(rows))}


@pytest.mark.parametrize("operator, brute", [(substrings.remove_repeated_words, substrings.brute_force), (suffixes.remove_repeated_bytes, suffixes.brute_force)])
def test_hot_passages_change_nothing(spark, monkeypatch, operator, brute):
    """Anchors count as hot from a few documents on; a passage stands in every document."""
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 2_000)
    rows = [(i, f"{prose(40)} {PASSAGE} {prose(40)}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = {r["doc_id"]: (r["n_removed"], bytes(r["kept"]) if isinstance(r["kept"], bytearray) else r["kept"]) for r in operator(df).collect()}
    assert found == {d: (x[1], x[-1]) for (d, _), x in zip(rows, brute(rows))}


@pytest.mark.parametrize("operator, brute", [(substrings.remove_repeated_words, substrings.brute_force), (suffixes.remove_repeated_bytes, suffixes.brute_force)])
def test_wide_buckets_change_nothing(spark, monkeypatch, operator, brute):
    """Buckets grow at once, and every piece of input sends blocks of its own to each."""
    for name, value in (("BUCKET_BYTES", 4_000), ("EVEN_BUCKETS", 2), ("FLUSH_BYTES", 1_000)):
        monkeypatch.setattr(repeats, name, value)
    rows = [(i, f"{prose(90, i)} {prose(70, i % 5)} {prose(60, i % 3)}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r["doc_id"]: (r["n_removed"], bytes(r["kept"]) if isinstance(r["kept"], bytearray) else r["kept"]) for r in operator(df).collect()}
    assert found == {d: (x[1], x[-1]) for (d, _), x in zip(rows, brute(rows))}
    assert any(n for n, _ in found.values())


def test_blocks_of_a_large_input():
    """6 GB of text make few enough buckets for the blocks of a flush to stay large; a slice's number fits a byte."""
    assert repeats.fan_out(0) == (1, repeats.SLICES)
    buckets, slices = repeats.fan_out(6e9 * suffixes.PHRASES.growth)
    assert repeats.FLUSH_BYTES * suffixes.PHRASES.growth / buckets > 40_000
    assert slices == repeats.SLICES * repeats.WIDEST <= 256


def test_blocks_are_cut_at_once():
    """The strings of a slice come out block by block, whatever the number of blocks."""
    rng, blocks = np.random.default_rng(1), []
    for _ in range(200):
        n = int(rng.integers(0, 9))
        size = rng.integers(1, 6, n).astype(np.int32)
        text = rng.integers(0, 256, int(size.sum())).astype(np.uint8)
        numbers = [rng.integers(-(2**62), 2**62, n), *(rng.integers(0, 2**31 - 1, n).astype(np.int32) for _ in range(2)), size]
        blocks.append([*numbers, np.sort(rng.integers(0, 7, n)).astype(np.uint8), text])
    packed = [repeats._unpack(repeats._pack(b[:-1], b[-1]), repeats._PACKED) for b in blocks]
    assert all(np.array_equal(x, y) for a, b in zip(packed, blocks) for x, y in zip(a, b))
    expected: dict[int, list] = {}
    for doc, first, count, size, part, text in blocks:
        ends = np.cumsum(size)
        for row in zip(doc.tolist(), first.tolist(), count.tolist(), size.tolist(), part.tolist(), ends.tolist()):
            expected.setdefault(row[4], []).append((*row[:4], text[row[5] - row[3] : row[5]].tobytes()))
    found = []
    for doc, first, count, size, text in repeats._by_slice(packed, 7):
        ends = np.cumsum(size)
        found.append([(*r[:4], text[r[4] - r[3] : r[4]].tobytes()) for r in zip(doc.tolist(), first.tolist(), count.tolist(), size.tolist(), ends.tolist())])
    assert found == [expected[k] for k in sorted(expected)]


def test_places_of_equal_prints():
    prints = np.random.default_rng(2).integers(0, 2**64, 5000, dtype=np.uint64)
    prints[[7, 4000, 4999]] = prints[3]
    prints[11] = prints[10] ^ np.uint64(1)  # differs in a bit that gives way to the place
    assert sorted(repeats._perhaps_equal(prints).tolist()) == [3, 7, 10, 11, 4000, 4999]
    assert repeats._perhaps_equal(prints[:1]).tolist() == repeats._perhaps_equal(prints[:0]).tolist() == []


@pytest.mark.parametrize("operator", [substrings.remove_repeated_words, suffixes.remove_repeated_bytes])
def test_repeats_of_rows_and_ids(spark, operator):
    """Rows of one id are one document; rows without an id are compared with none; names may clash."""
    rows = [(5, PASSAGE, "a", 1), (5, PASSAGE, "a", 1), (None, PASSAGE, "b", 2), (None, PASSAGE, None, 3), (4, "short", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_removed string, _text int")
    found = operator(df, keep=("doc_id", "n_removed", "_text")).collect()
    assert sorted(r["_text"] or 0 for r in found) == [0, 1, 1, 2, 3]
    assert all(r["n_removed"] == 0 for r in found)
    first = operator(spark.createDataFrame([*rows, (1, PASSAGE, "c", 9)], df.schema)).filter("doc_id = 5").collect()
    assert len(first) == 2 and all(r["n_removed"] > 0 for r in first)


@pytest.mark.parametrize(
    "name", ["op1_substring_dedup", "op2_jaccard_join", "op3_byte_bpe", "op5_benchmark_decontamination", "op6_suffix_dedup", "op8_quality", "op9_license_scan", "op10_language_id"]
)
def test_empty_tables(spark, data_dir, tmp_path, name):
    for table in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{data_dir}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert QUERIES[name].run(spark, str(tmp_path)).collect() == []


def test_similar_documents(either):
    rows, df = either
    found = by_id(similarity.similar_documents(df), "class_id", "n_links")
    assert found == similarity.brute_force(rows)


def near_copies(n, words=400):
    base = prose(words, 9).split()
    rows = []
    for i in range(n):
        copy = list(base)
        for _ in range(RANDOM.randint(0, 3)):
            copy[RANDOM.randrange(words)] = f"other{RANDOM.randrange(10**6)}"
        rows.append((i * 3 + 1, " ".join(copy)))
    return rows + [(i * 3, prose(60)) for i in range(40)]


def test_large_groups_of_near_copies(spark):
    rows = near_copies(150)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = by_id(similarity.similar_documents(df), "class_id", "n_links")
    assert found == similarity.brute_force(rows)


def test_more_near_copies_than_a_leaf(spark):
    """Every copy has one word changed, so it is similar to the base text, and all are one class."""
    base = prose(60, 9).split()
    rows = [(7, " ".join(base))]
    for i in range(similarity.LEAF + 200):
        copy = list(base)
        copy[5 + i % 50] = f"other{i}"
        rows.append((i + 10, " ".join(copy)))
    rows += [(i + 5_000, prose(60)) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = by_id(similarity.similar_documents(df), "class_id", "n_links")
    assert {d: c for d, (c, _) in found.items()} == {d: 7 if d < 5_000 else d for d, _ in rows}
    assert found == similarity.brute_force(rows)


def test_large_clusters_keep_their_classes(spark, monkeypatch):
    monkeypatch.setattr(similarity, "MOST_IN_UNIT", 20)
    rows = near_copies(120)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = by_id(similarity.similar_documents(df), "class_id", "n_links")
    assert found == similarity.brute_force(rows)


@pytest.mark.parametrize("part, shingles", [(1_000, 500_000), (15, 500_000), (1_000, 6_000)])
def test_large_clusters_count_every_link(spark, monkeypatch, part, shingles):
    """Copies cut to different lengths fall into several bands of size; part against part finds every link."""
    monkeypatch.setattr(similarity, "MOST_IN_UNIT", 20)
    monkeypatch.setattr(similarity, "MOST_IN_PART", part)
    monkeypatch.setattr(similarity, "SHINGLES_IN_PART", shingles)
    rows = [(d, " ".join(t.split()[: 400 - (d % 8) * 20])) for d, t in near_copies(150)] + near_copies(20)[:10]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string").repartition(5)
    found = by_id(similarity.similar_documents(df), "class_id", "n_links")
    brute = similarity.brute_force([(i, t) for i, (_, t) in enumerate(rows)])
    assert found == brute and max(n for _, n in brute.values()) > 60


def test_more_links_than_pivots(spark):
    """As many copies as fill a large cluster at its real size, each with all its links."""
    base = prose(60, 9).split()
    rows = [(i, " ".join([*base[: 5 + i % 50], f"other{i}", *base[6 + i % 50 :]])) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert by_id(similarity.similar_documents(df), "class_id", "n_links") == similarity.brute_force(rows)


def test_sliding_excerpts_over_several_batches():
    """B is close to A, the first of its batch, and C to D, the first of another; B and C are linked, A and D are not."""
    words = prose(204, 19).split()
    cuts = {10: words[:159], 20: words, 15: words[41:], 5: words[78:]}
    table = pa.RecordBatch.from_pydict({"id": list(cuts), "text": [" ".join(x) for x in cuts.values()]})
    (sketched,) = similarity._sketch(iter([table]))
    sketch = dict(zip(cuts, sketched.column("sketch").to_pylist()))

    def agree(a, b):
        x, y = (similarity._matrix(pa.array([sketch[k]])) for k in (a, b))
        return similarity.agreement(x, y)[0, 0]

    assert min(agree(10, 20), agree(5, 15)) >= similarity.CLOSE and agree(10, 5) < similarity.COARSE <= agree(20, 15)
    batches = [[(10, 10), (20, 20), *((100 + i, 10) for i in range(30))], [(5, 5), (15, 15), *((200 + i, 5) for i in range(30))]]
    dealt = []
    for batch in batches:
        fields = {"path": [1] * len(batch), "rep": [k for k, _ in batch], "sketch": [sketch[of] for _, of in batch]}
        dealt += similarity._combine(iter([pa.RecordBatch.from_pydict(fields)]))
    rows = pa.Table.from_batches(dealt).sort_by([("path", "ascending"), ("rep", "ascending")]).combine_chunks()
    met = pa.Table.from_batches(list(similarity._meet(iter(rows.to_batches())))).to_pylist()
    label = {k: k for batch in batches for k, _ in batch}
    for _ in label:
        for x in met:
            if x["path"] is None:
                label[x["rep"]] = label[x["other"]] = min(label[x["rep"]], label[x["other"]])
    assert set(label.values()) == {5}


def test_runs_follow_the_steps():
    assert [similarity.runs_for(k, 0.996) for k in (1, 2, 3)] == [6, 9, similarity.RUNS]
    assert similarity.runs_for(15, 0.996) > 40 and similarity.runs_for(3, 0.9999) > similarity.RUNS


def test_deep_classes_get_more_runs(spark, monkeypatch):
    """Texts of three hot passages each go on to longer paths, and are read again for the runs that their steps need."""
    asked = []
    follow = similarity._follow

    def told(classes, needed, first):
        rows = {r["rep"]: len(r["paths"]) for r in classes.select("rep", "paths").collect()}
        links, deep = follow(classes, needed, first)
        asked.append((rows, {r["rep"] for r in deep.select("rep").distinct().collect()} if deep is not None else set()))
        return links, deep

    monkeypatch.setattr(similarity, "_follow", told)
    passages = [prose(40, k) for k in range(5)]
    rows = [(i, " ".join([*random.Random(i).sample(passages, 3), f"end{i}", prose(60, 50 + i)])) for i in range(2_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    similarity.similar_documents(df, recall=0.9999).count()
    assert len(asked) > 1 and set(asked[1][0]) == asked[0][1] and sum(asked[1][0].values()) > 0


def test_open_clusters_end(spark, monkeypatch):
    """Texts that share more than half of their words form one coarse cluster and link with few; it ends in one pass."""
    monkeypatch.setattr(similarity, "MOST_IN_UNIT", 20)
    monkeypatch.setattr(similarity, "MOST_TURNS", 2, raising=False)
    rows = [(i, prose(70, 7) + " " + prose(30, 1_000 + i // 2) + f" end{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = by_id(similarity.similar_documents(df), "class_id", "n_links")
    assert found == similarity.brute_force(rows) and {n for _, n in found.values()} == {1}


def test_similar_rows_without_ids(spark):
    rows = [(None, PASSAGE), (3, PASSAGE), (3, PASSAGE), (9, PASSAGE + " end"), (2, ""), (1, None)]
    found = similarity.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r[0] or 0, r[1] or 0, r[2]) for r in found) == [(0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 2), (3, 3, 2), (9, 3, 2)]


def test_bpe_against_the_library(either):
    rows, df = either
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ids, special_tokens={})
    found = by_id(bpe.encode_documents(df, vocabulary, public_tokenizers.PATTERN), "ids", "n_tokens", "ids_sha256", "decoded_sha256")
    for d, text in rows:
        ids = library.encode_ordinary(text or "")
        coded = b"".join(i.to_bytes(4, "little") for i in ids)
        assert found[d] == (ids, len(ids), sha(coded), sha(text or ""))


def test_bpe_of_every_kind_of_sign():
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ids, special_tokens={})
    signs = [chr(i) for i in [*range(0x250), 0x1680, 0x2003, 0x2028, 0x3000, 0xFEFF, 0x1F600]]
    texts = [s * k + " a" + s + "b \n" + s for s in signs for k in (1, 3)] + ["a" * n for n in range(40)]
    ids, cuts = bpe.Encoder(vocabulary, public_tokenizers.PATTERN).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == [library.encode_ordinary(t) for t in texts]


def test_bpe_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b", "x", 7)], "doc_id long, text string, `_text` string, n_tokens int")
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    row = bpe.encode_documents(df, vocabulary, public_tokenizers.PATTERN, keep=tuple(df.columns)).first()
    assert (row["_text"], row["n_tokens"], len(row["ids"])) == ("x", 2, 2)


def test_contamination(spark, data_dir, either):
    rows, df = either
    items = [tuple(r) for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").select("item_id", "text").collect()]
    items += [(900, "one"), (901, PASSAGE), (902, None), (903, " ... "), (904, prose(50, 2).upper()), (904, prose(13, 2)), (905, "ÉÏ é")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = by_id(contamination.contamination_digest(contamination.find_benchmark_passages(df, benchmark)), "n_words", "n_hit", "items_sha256")
    assert found == {d: contamination.brute_force(t, items) for d, t in rows}


def test_contamination_spans_and_filter(spark):
    passage = "Alpha beta, GAMMA delta. Epsilon é zeta eta theta iota kappa lambda mu"
    rows = [(1, f"ø ø!! {passage}; nu", "x"), (2, f"{passage} " + "word " * 300, "y"), (3, None, None), (4, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_hit string")
    items = spark.createDataFrame([(7, passage.lower())], "item_id long, text string")
    first = contamination.find_benchmark_passages(df, items).filter("doc_id = 1").first()
    assert [rows[0][1][s["start"] : s["end"]] for s in first["spans"]] == [passage]
    kept = contamination.decontaminate(df, items)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"], r["n_hit"]) for r in kept.collect()) == [(2, "y"), (3, None), (4, "z")]


@pytest.mark.parametrize("slice_bytes", [40, 400, 5_000])
def test_benchmark_in_slices(spark, slice_bytes):
    """However small the slices of the automaton, also within one long item, the rows are the same."""
    items = [(1, prose(200, 51)), (2, prose(9, 52)), (3, None), (4, prose(60, 53)), (5, ""), (1, prose(20, 54))]
    bodies = [t for _, t in items if t]
    texts = [None, "", prose(40), *bodies, " ".join(bodies), prose(30) + " " + bodies[0][100:600] + " " + bodies[1], bodies[1] + " x " + bodies[1]]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    digest = contamination.contamination_digest(contamination.find_benchmark_passages(df, benchmark, slice_bytes=slice_bytes))
    found = by_id(digest, "n_words", "n_hit", "items_sha256")
    assert found == {d: contamination.brute_force(t, items) for d, t in rows}
    whole = contamination.find_benchmark_passages(df, benchmark)
    by_slices = contamination.find_benchmark_passages(df, benchmark, slice_bytes=slice_bytes)
    assert by_id(by_slices, "spans", "items") == by_id(whole, "spans", "items")


def test_licences(spark):
    texts = {
        1: "Code.\nReleased under the MIT license!",
        2: "released under the    mit",
        3: "LICENSED under the Apache License, version 2.0 " * 2,
        4: "x " * 5_000 + "All rights reserved.",
        5: None,
        6: "",
        7: "a This work is licensed under the GNU General Public License, version 3.",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("licences", F.lit("clash"))
    found = by_id(licences.scan_licences(df, keep=("doc_id", "licences")), "licences")
    assert {d: x[0] for d, x in found.items()} == {1: ["mit"], 2: [], 3: ["apache-2.0"], 4: ["all-rights-reserved"], 5: [], 6: [], 7: ["gpl-3.0"]}
    assert by_id(licences.scan_licences(df.limit(1), templates={"short": "word"}), "licences") == {1: ([],)}


def test_licence_plan_is_native(spark, data_dir):
    plan = QUERIES["op9_license_scan"].run(spark, data_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Exchange"))


def test_language_accuracy(spark, given):
    documents = given[1]
    found = languages.predict(documents, languages.learn(documents), keep=("doc_id", "lang")).join(
        documents.select("doc_id", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)).alias("fold")), "doc_id"
    )
    held = found.filter("fold = 1 and lang is not null")
    right = held.filter("lang = lang_pred").count()
    assert right >= 0.95 * held.count() > 0
    assert found.filter("score < 0 or score > 1").count() == 0


def test_language_cases(spark):
    english, german = "the house and the garden of the man ", "das Haus und der Garten des Mannes "
    rows = [(i, (english, german)[i % 2] * 5, ("en", "de")[i % 2]) for i in range(40)]
    model = languages.fit([(lang, t) for _, t, lang in rows])
    cases = {1: "the garden", 2: "der Garten", 3: None, 4: "", 5: "12 + !?", 6: "— … —", 7: english * 30 + german * 3, 8: german * 3_000}
    df = spark.createDataFrame(list(cases.items()), "doc_id long, text string").withColumn("score", F.lit("clash"))
    found = by_id(languages.predict(df, model, keep=("doc_id", "score")), "lang_pred")
    assert {d: x[0] for d, x in found.items()} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und", 6: "und", 7: "en", 8: "de"}
    assert model.steps[0, 0] > model.steps[0, 1] and model.steps[1, 1] > model.steps[1, 0]
    nothing = languages.learn(spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string"))
    assert by_id(languages.predict(df, nothing), "lang_pred", "score")[1] == ("und", 0.0)


def test_marginals_against_all_paths():
    """Forward-backward on short texts against the sum over every sequence of labels."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    model = languages.Model(["a", "b", "c"], np.zeros((1, 3), np.float32), rng.normal(size=(3, 3)))
    offsets = np.array([0, 4, 4, 5, 8])
    scores = rng.normal(size=(8, 3))
    found = model.mean_marginals(scores, offsets)
    for k, (a, b) in enumerate(zip(offsets, offsets[1:])):
        if a == b:
            assert not found[k].any()
            continue
        total = np.zeros((b - a, 3))
        for path in itertools.product(range(3), repeat=int(b - a)):
            weight = np.exp(sum(scores[a + t, y] for t, y in enumerate(path)) + sum(model.steps[x, y] for x, y in zip(path, path[1:])))
            for t, y in enumerate(path):
                total[t, y] += weight
        assert np.allclose(found[k], (total / total.sum(axis=1, keepdims=True)).mean(axis=0))


def test_quality_accuracy(spark, data_dir, given):
    documents, labels = given[1], spark.read.parquet(f"{data_dir}/labels.parquet")
    scored = quality.score(documents, quality.learn(documents, labels))
    held = scored.join(labels, "doc_id").filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1)
    right = held.filter("predicted = quality").count()
    assert right >= 0.9 * held.count() > 0


def test_quality_cases(spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    df = spark.createDataFrame([(1, "good words here", "x"), (3, None, "y"), (4, "", None), (5, "w " * 9_000, "z")], "doc_id long, text string, score string")
    scored = quality.score(df, quality.learn(df, labels), keep=("doc_id", "score")).collect()
    assert len(scored) == 4 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in scored)
    untaught = quality.score(df, quality.learn(df, labels.limit(0))).collect()
    assert {r["score"] for r in untaught} == {0.5}


def colliding_words():
    """Two words of 1,024 letters that collide under every polynomial hash modulo 2**64."""
    one, two = "a", "b"
    for _ in range(10):
        one, two = one + two, two + one
    return one, two


@pytest.mark.parametrize("operator, brute", [(substrings.remove_repeated_words, substrings.brute_force), (suffixes.remove_repeated_bytes, suffixes.brute_force)])
def test_colliding_words(spark, operator, brute):
    """Whatever a hash says, only equal words or bytes count as repeats, in one task and across tasks."""
    one, two = colliding_words()
    before, after = prose(30, 41), prose(30, 42)
    rows = [(i, f"{before} {w} {after}") for i, w in enumerate([one, two, one, two, one * 2, two * 2, one + two, two + one])]
    for parts in (1, 8):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        found = {r["doc_id"]: (r["n_removed"], r["kept"] if isinstance(r["kept"], str) else bytes(r["kept"])) for r in operator(df).collect()}
        assert found == {d: (x[1], x[-1]) for (d, _), x in zip(rows, brute(rows))}


@pytest.mark.parametrize("operator, brute", [(substrings.remove_repeated_words, substrings.brute_force), (suffixes.remove_repeated_bytes, suffixes.brute_force)])
def test_bounded_portions_change_nothing(spark, monkeypatch, operator, brute):
    """Buckets worked on in small chunks and few windows at a time give the same rows."""
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 600)
    monkeypatch.setattr(repeats, "PORTION", 50)
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    method = substrings.SUPER_KMERS if operator is substrings.remove_repeated_words else suffixes.PHRASES
    found = {}
    data, offsets = method.normalise(*repeats.joined([(t or "").encode() for _, t in rows]))
    symbols = method.symbols(data, offsets)
    windows = repeats.np.maximum(repeats.np.diff(symbols.offsets) - repeats.WIDTH + 1, 0)
    owner, place = repeats.repeated_windows(data, offsets, method, windows, repeats.np.arange(len(rows)), repeats.WIDTH)
    for o, p in zip(owner.tolist(), place.tolist()):
        found.setdefault(o, set()).update(range(p, p + repeats.WIDTH))
    assert {d: len(found.get(d, ())) for d, _ in rows} == {d: x[1] for (d, _), x in zip(rows, brute(rows))}


def test_windows_of_one_print(monkeypatch):
    """Where a print says that all windows are equal, their bytes tell them apart."""
    texts = [b"x" * 60, b"y" * 60, b"x" * 60, b"z" * 60, b"y" * 60]
    data, offsets = repeats.joined(texts)
    monkeypatch.setattr(repeats.Rolling, "every", lambda self, width: repeats.np.zeros(max(self.n - width + 1, 0), repeats.np.uint64))
    count = repeats.np.full(5, 11)
    owner, place = repeats.repeated_windows(data, offsets, suffixes.PHRASES, count, repeats.np.arange(5), 50)
    assert [(o, p) for o, p in zip(owner.tolist(), place.tolist())] == [(o, p) for o in (2, 4) for p in range(11)]
