"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridloom.llm.folds import held_out, per_label
from gridloom.llm.rows import ROW, named, opened, row_schema, with_row
from gridloom.llm.text import Rolling, byte_codes, mix, pieces, utf8, word_spans

BUCKETS = 1 << 18
SAMPLE_ROWS = 4_000  # of each label
SHARDS = 4
EPOCHS = 3
RATE, SMOOTH, L1, L2 = 0.1, 1.0, 0.02, 0.1

_SPACES = np.array([b > 0x20 for b in range(256)])
_LETTERS = np.zeros(256, bool)
_LETTERS[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = True
_LETTERS[0x80:] = True
_SHAPE = np.full(256, ord("p"), np.uint8)
_SHAPE[_LETTERS] = ord("a")
_SHAPE[0x30:0x3A] = ord("0")
_SHAPE[0x41:0x5B] = ord("A")


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each text, one after another, and the n+1 offsets of the texts.

    Tokens are runs of letters and digits and runs of other signs. Each gives itself, the pair with the
    token after it, the shape of both (capitals, letters, digits, signs, at most the first and the
    last byte and the length up to 8) and whether the same token came one or two places before.
    """
    words, word_ends, _ = word_spans(data, offsets, _LETTERS)
    signs, sign_ends, _ = word_spans(data, offsets, _SPACES & ~_LETTERS)
    starts, ends = np.concatenate((words, signs)), np.concatenate((word_ends, sign_ends))
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    cuts = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), cuts
    token = Rolling(byte_codes(7)[data]).stretches(starts, ends)
    kind = _SHAPE[data]
    shape = kind[starts].astype(np.uint64) << np.uint64(16) | kind[ends - 1].astype(np.uint64) << np.uint64(8)
    shape = mix(shape | np.minimum(ends - starts, 8).astype(np.uint64))
    first = np.zeros(len(starts), bool)
    first[cuts[:-1][np.diff(cuts) > 0]] = True

    def before(x: np.ndarray, places: int) -> np.ndarray:
        out = np.zeros_like(x)
        out[places:] = x[:-places]
        for k in range(places):
            out[np.flatnonzero(first)[np.flatnonzero(first) + k < len(x)] + k] = 1
        return out

    last, last_shape = before(token, 1), before(shape, 1)
    again = (token == last).astype(np.uint64) + np.uint64(2) * (token == before(token, 2)).astype(np.uint64)
    made = [token, mix(token * np.uint64(3) + last), mix(shape + np.uint64(17)), mix(shape * np.uint64(5) + last_shape), mix(again + np.uint64(91))]
    return (np.stack(made, axis=1) % np.uint64(BUCKETS)).astype(np.int64).ravel(), cuts * len(made)


def _values(n: int) -> float:
    """Each occurrence weighs one over the square root of the number of features of its text."""
    return 1 / np.sqrt(n) if n else 0.0


def follow_leader(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias from rows of (features, label), read in order ``epochs`` times."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weight(at: np.ndarray) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * L1) / ((SMOOTH + np.sqrt(n[at])) / RATE + L2)
        return np.where(np.abs(z[at]) <= L1, 0.0, w)

    ready = []
    for numbers, label in rows:
        at, counts = np.unique(numbers, return_counts=True)
        ready.append((np.append(at, BUCKETS), np.append(counts * _values(len(numbers)), 1.0), label))
    for _ in range(epochs):
        for at, x, label in ready:
            w = weight(at)
            slope = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
            step = (np.sqrt(n[at] + slope**2) - np.sqrt(n[at])) / RATE
            z[at] += slope - step * w
            n[at] += slope**2
    w = weight(np.arange(BUCKETS + 1))
    return w[:-1], float(w[-1])


def learn(documents: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> tuple[np.ndarray, float]:
    """Weights and bias from a bounded sample of labelled documents outside the held-out part.

    About ``SAMPLE_ROWS`` ids of each label are chosen by a hash of the id; they are few enough to be
    broadcast to the documents. They are dealt to ``SHARDS`` tasks, each of which follows its own
    leader over its rows, and the weights are averaged. Null labels and ids are left out; of several
    labels for one id the greatest counts.
    """
    known = labels.select(named(doc_id).alias("id"), named(label).cast("int").alias("label"), (~held_out(doc_id)).alias("learn"))
    known = known.filter("learn and id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    chosen = F.broadcast(per_label(known, "label", "id", SAMPLE_ROWS))
    rows = documents.select(named(doc_id).alias("id"), named(text).alias("_text")).join(chosen, "id")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(1)), F.lit(SHARDS)))

    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending")])
        ready = []
        for batch in pieces(iter(table.combine_chunks().to_batches()), "_text"):
            numbers, cuts = features(*utf8(batch.column("_text")))
            ready += [(numbers[a:b], y) for a, b, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), batch.column("label").to_pylist())]
        order = np.random.default_rng(1).permutation(len(ready))
        weights, bias = follow_leader([ready[i] for i in order])
        return pa.table({"weights": [weights.astype("<f8").tobytes()], "bias": [bias]})

    found = rows.groupBy("shard").applyInArrow(train, "weights binary, bias double").collect()
    if not found:
        return np.zeros(BUCKETS), 0.0
    return np.mean([np.frombuffer(r["weights"], "<f8") for r in found], axis=0), float(np.mean([r["bias"] for r in found]))


def score(documents: DataFrame, model: tuple[np.ndarray, float], *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with ``score`` (0 to 1) and ``predicted`` (1 if the score is 0.5 or more).

    The score is the logistic function of the sparse dot product of the whole text's features with the
    weights, plus the bias. A null or empty text has no features and gets the bias alone; without any
    label to learn from, every score is 0.5. Repeated rows are scored alike; an empty table gives an
    empty result. No shuffle is needed.
    """
    source = with_row(documents, keep, _text=named(text))
    lookup = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = lookup.value
        for batch in pieces(batches, "_text"):
            numbers, cuts = features(*utf8(batch.column("_text")))
            sums = np.concatenate(([0.0], np.cumsum(weights[numbers])))
            n = np.diff(cuts)
            margin = (sums[cuts[1:]] - sums[cuts[:-1]]) / np.sqrt(np.maximum(n, 1)) + bias
            value = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(ROW), pa.array(value), pa.array((value >= 0.5).astype(np.int32))], names=[ROW, "score", "predicted"]
            )

    return opened(source.mapInArrow(run, row_schema(source, "score double, predicted int")))
