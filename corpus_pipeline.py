"""From raw documents to token ids: language, near copies, repeated passages, benchmarks, BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.llm import bpe, contamination, languages, similarity, substrings
from gridloom.llm.base import Query, table
from gridloom.llm.rows import named
from gridloom.session import settle

LEAST_LANGUAGE_SCORE = 0.35


def _whole(docs: DataFrame) -> DataFrame:
    """Each document as one struct beside the id and the text that an operator reads."""
    return docs.select(F.struct(*map(named, docs.columns)).alias("document"), named("doc_id").alias("doc_id"), named("text").alias("text"))


def _columns(docs: DataFrame) -> list:
    return [F.col("document")[c].alias(c) for c in docs.columns]


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of no language, and those whose words lean to no language by ``LEAST_LANGUAGE_SCORE``.

    Learns from the documents' own non-null ``lang`` outside the held-out part; if there is none,
    nothing can be judged and every document stays.
    """
    model = languages.learn(docs)
    if not model.labels:
        return docs
    found = languages.predict(_whole(docs), model, keep=("document",))
    known = (F.col("lang_pred") != languages.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return found.filter(known).select(*_columns(docs))


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar documents the one of least doc_id stays, of repeated rows one.

    Documents without an id are compared with none and stay.
    """
    classes = similarity.similar_documents(docs.select("doc_id", "text"))
    kept = classes.filter("doc_id = class_id").select("doc_id").distinct()
    one = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*map(named, docs.columns))
    return one.unionByName(docs.filter("doc_id is null"))


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that a smaller doc_id holds too go; a text that loses any is joined by single
    spaces, others stay as they are, and ``n_chars`` follows. No document is dropped."""
    found = substrings.remove_repeated_words(_whole(docs), keep=("document",))
    document = F.col("document")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(document["text"])
    own = {"text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*(own.get(c, document[c]).alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more lies in benchmark passages go."""
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of each document."""
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode_documents(docs, vocabulary, public_tokenizers.PATTERN)


STAGES = [
    ("language_id", keep_known_language),
    ("jaccard_join", keep_one_of_similar),
    ("substring_dedup", remove_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The language model, the random sketches and the BPE merges are no SQL; tests use brute force.
ORACLE_SQL = None
QUERY = Query(run, ORACLE_SQL)
