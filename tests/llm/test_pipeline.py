"""The stages of the pipeline on a small corpus with planted cases, and on the given documents."""

import random

import corpus_pipeline
import pytest
from gridloom.llm import contamination, similarity, substrings


def words(n, seed):
    source = random.Random(seed)
    return " ".join(random.Random(1).choices(["the", "of", "and", "house", "garden", "over"], k=2) + ["".join(source.choices("abcdefgh", k=6)) for _ in range(n)])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    passage, question = words(60, 2), words(30, 3)
    rows = [(i, words(120, 100 + i), "en", f"s{i}") for i in range(30)]
    rows += [(50, rows[4][1], "en", "copy"), (51, rows[5][1] + " end", "en", "near copy")]
    rows += [(60, f"{words(90, 60)}\n{passage}", "en", "holds"), (61, f"{passage}\n{words(90, 61)}", "en", "repeats")]
    rows += [(70, f"{question} {words(40, 70)}", "en", "contaminated"), (80, "123 !!", None, "no letters"), (81, None, None, None), (None, words(80, 9), None, "no id")]
    frame = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, question)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), {r[0]: r[1] for r in rows}


def test_stages(spark, folder, tmp_path):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, ids = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        ids[name] = {r["doc_id"]: r for r in docs.collect()}
        assert k == 4 or docs.columns == columns
    everything = set(texts)
    assert everything - set(ids["language_id"]) == {80, 81}
    assert set(ids["language_id"]) - set(ids["jaccard_join"]) == {50, 51}
    assert set(ids["substring_dedup"]) == set(ids["jaccard_join"])
    changed = {d for d, r in ids["substring_dedup"].items() if r["text"] != texts[d]}
    assert changed == {61} and ids["substring_dedup"][61]["text"].split() == texts[61].split()[62:]
    assert all(r["n_chars"] == len(r["text"]) for r in ids["substring_dedup"].values())
    assert set(ids["substring_dedup"]) - set(ids["benchmark_decontamination"]) == {70}
    assert set(ids["byte_bpe"]) == set(ids["benchmark_decontamination"])


def test_run_against_brute_force(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    known = corpus_pipeline.keep_known_language(spark, docs, data_dir)
    rows = sorted((r["doc_id"], r["text"]) for r in known.collect())
    classes = similarity.brute_force(rows)
    rows = [(d, t) for d, t in rows if classes[d][0] == d]
    rows = [(d, kept if gone else t) for (d, t), (_, gone, kept) in zip(rows, substrings.brute_force(rows))]
    items = [tuple(r) for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").select("item_id", "text").collect()]
    counts = {d: contamination.brute_force(t, items) for d, t in rows}
    want = {d: t for d, t in rows if not (counts[d][1] and 20 * counts[d][1] >= counts[d][0])}
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, data_dir).collect()}
    assert set(found) == set(want)
    import hashlib

    assert all(found[d]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest() for d, t in want.items())


def test_empty_documents(spark, folder, tmp_path):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, path)
        assert docs.collect() == []
        if k == 3:
            break
