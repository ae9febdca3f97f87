"""Near-duplicate embeddings: sign hashes in several tables, exact cosines, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridloom.llm.components import connected_components
from gridloom.llm.rows import named

COSINE = 0.9
RECALL = 0.998
MEAN_BUCKET = 64
MOST_IN_UNIT = 2_000
SEED = 20_240


def table_plan(vectors: int, cosine: float, recall: float) -> tuple[int, int]:
    """Bits of a code, and tables: a pair at ``cosine`` shares a code somewhere with chance ``recall``.

    The bits follow the number of vectors, so that a bucket holds ``MEAN_BUCKET`` of unrelated ones.
    """
    bits = min(30, max(1, ceil(log2(max(vectors, 2) / MEAN_BUCKET)))) if vectors > MEAN_BUCKET else 0
    if not bits:
        return 0, 1
    meet = (1 - acos(cosine) / pi) ** bits
    return bits, ceil(log(1 - recall) / log(1 - meet))


@lru_cache(maxsize=8)
def _planes(tables: int, bits: int, size: int) -> np.ndarray:
    return np.random.default_rng(SEED + size).standard_normal((size, tables * bits))


def codes(unit: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """The code of each vector in each table."""
    signs = unit @ _planes(tables, bits, unit.shape[1]) >= 0
    return signs.reshape(len(unit), tables, bits) @ (1 << np.arange(bits))


def _matrices(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) for each length of vector."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        x = flat[(starts[rows][:, None] + np.arange(size)).ravel()].reshape(len(rows), size)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        yield rows, x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _deal(tables: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column("vector")
            for rows, unit in _matrices(vectors):
                code = codes(unit, tables, bits)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(rows), t, np.int32)),
                            pa.array(np.full(len(rows), unit.shape[1], np.int32)),
                            pa.array(code[:, t].astype(np.int64)),
                            batch.column("rep").take(pa.array(rows)),
                            batch.column("copies").take(pa.array(rows)),
                            vectors.take(pa.array(rows)),
                        ],
                        names=["part", "size", "code", "rep", "copies", "vector"],
                    )

    return run


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index that each of n nodes reaches over the links (i, j)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            return label


def _compare(tables: int, bits: int, cosine: float):
    """Links inside one unit: one block of a bucket, or two blocks of it.

    A pair is counted in the first table in which its codes agree. Only sums for each vector and one
    edge to the least vector of its piece leave the unit, not the pairs.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part, first, second = key[0].as_py(), key[3].as_py(), key[4].as_py()
        rep = table.column("rep").to_numpy()
        order = np.argsort(rep)
        rep, copies = rep[order], table.column("copies").to_numpy()[order]
        side = table.column("side").to_numpy()[order]
        vectors = table.column("vector").combine_chunks().take(pa.array(order))
        ((_, unit),) = _matrices(vectors)
        code = codes(unit, tables, bits)
        links = np.zeros(len(rep), np.int64)
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for a in range(0, len(rep), 512):
            i, j = np.nonzero(unit[a : a + 512] @ unit.T >= cosine)
            i += a
            near = (i < j) & (True if first == second else side[i] != side[j])
            i, j = i[near], j[near]
            new = ~(code[i, :part] == code[j, :part]).any(axis=1) if part else np.ones(len(i), bool)
            np.add.at(links, i[new], copies[j[new]])
            np.add.at(links, j[new], copies[i[new]])
            ends.append((i, j))
        i, j = (np.concatenate(x) for x in zip(*ends))
        label = _labels(len(rep), i, j)
        told = np.flatnonzero((links > 0) | (label != np.arange(len(rep))))
        return pa.table([pa.array(rep[told]), pa.array(links[told]), pa.array(rep[label[told]])], names=["rep", "links", "least"])

    return run


def near_duplicates(
    vectors: DataFrame,
    *,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    cosine: float = COSINE,
    recall: float = RECALL,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row.

    ``n_links`` counts the other vectors of cosine ``cosine`` or more, in double precision, that were
    found; ``component_id`` is the least vec_id reached over links; ``kept`` marks that vector.

    Equal vectors are one class from the start, whatever their number, and count as linked copies.
    Classes are hashed by the signs of their products with random planes, in as many tables as bring a
    pair at the threshold together with chance ``recall``; pairs in a bucket are compared exactly. A
    bucket of more than ``MOST_IN_UNIT`` classes is cut into blocks by id and compared block by block,
    each pair of blocks in a task of its own, so that no bucket is capped. Up to ``MEAN_BUCKET`` classes
    share one bucket, and the search is then exhaustive.

    A vector that is null, empty, zero or holds a null, NaN or infinity links with nothing, and so does
    one without an id; vectors of different lengths are never compared; repeated rows are copies of
    each other; an empty table gives an empty result; other columns, such as labels, are not read.
    """
    values = named(embedding).cast("array<double>")
    usable = named(vec_id).isNotNull() & F.forall(values, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(values, lambda x: x != 0)
    source = vectors.select(named(vec_id).cast("long").alias("vec_id"), F.when(usable, values).alias("vector"))
    classes = source.filter("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    bits, tables = table_plan(classes.count(), cosine, recall)

    fields = "part int, size int, code long, rep long, copies long, vector array<double>"
    dealt = classes.select("vector", "rep", "copies").mapInArrow(_deal(tables, bits), fields)
    bucket = ["part", "size", "code"]
    large = dealt.groupBy(*bucket).count().filter(F.col("count") > MOST_IN_UNIT)
    blocks = F.coalesce(F.ceil(F.col("count") / (MOST_IN_UNIT // 2)), F.lit(1)).cast("int")
    placed = dealt.join(large, bucket, "left").withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    units = placed.withColumn("other", other).select(
        *bucket, F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "rep", "copies", "vector"
    )
    found = units.groupBy(*bucket, "low", "high").applyInArrow(_compare(tables, bits, cosine), "rep long, links long, least long")
    found = found.groupBy("rep", "least").agg(F.sum("links").alias("links")).checkpoint()

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    reached = connected_components(found.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    known = (
        classes.join(links, "rep", "left")
        .join(reached.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            F.xxhash64(F.lit(1), "vector").alias("k1"),
            F.xxhash64(F.lit(2), "vector").alias("k2"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    keyed = source.select(
        "vec_id",
        F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(1), "vector")).alias("k1"),
        F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(2), "vector")).alias("k2"),
    )
    joined = keyed.join(known, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def brute_force(rows: list[tuple[int, list[float] | None]], cosine: float = COSINE) -> dict[int, tuple[int, int]]:
    """(n_links, component_id) of each vector, from all pairs."""
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {i: (0, i) for i, _ in rows}
    if good:
        ids = np.array([i for i, _ in good])
        order = np.argsort(ids)
        x = np.stack([good[k][1] / np.abs(good[k][1]).max() for k in order])
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        i, j = np.nonzero(np.triu(x @ x.T >= cosine, 1))
        links = np.bincount(np.concatenate((i, j)), minlength=len(ids))
        label = _labels(len(ids), i, j)
        ids = ids[order]
        out |= {int(a): (int(n), int(ids[k])) for a, n, k in zip(ids, links, label)}
    return out
