"""Mixture-controlled packing: deficit round-robin over the token queues of the sources.

Each source is owed its share of every window. A source is served once it is owed ``quantum`` tokens; what
it is owed beyond what it got, its deficit, is carried to the next window. Where queues run dry, the
others fill the window in rounds by their shares and so go into debt.

Documents are dealt by a hash into parts of about ``PART_TOKENS`` tokens, and a part is packed by one task.
All tokens of a part are packed in it, so the deficits at its end are known before anything is packed:
a source's share of all tokens up to there, less its own tokens up to there. Running totals over
(part, source) counts carry them from part to part, and every part starts at once.

A part's last tokens fill sequences whose lengths are powers of two, so nothing is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from gridloom.llm.rows import ROW, named, opened, row_schema, with_row
from gridloom.llm.text import give_back, pieces, utf8
from gridloom.llm.tokens import ByteBpe, flat_ids
from gridloom.session import settle

LENGTH = 2048
QUANTUM = 64
PART_TOKENS = 1 << 20
STRETCH = 1024
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _tokenise(file, pattern: str, end: int):
    """Ids of each document, the closing one included, as 16-bit or 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.of(file.value, pattern)
        wide = "<u2" if max(len(bpe.token_bytes), end + 1) <= 1 << 16 else "<u4"
        for batch in pieces(batches, "_text"):
            data, offsets = utf8(batch.column("_text"))
            raw, cuts = data.tobytes(), offsets.tolist()
            encoded = [bpe.encode(raw[a:b].decode()) if b > a else [] for a, b in zip(cuts, cuts[1:])]
            ids, at = flat_ids([[*x, end] for x in encoded])
            blob, size = ids.astype(wide).tobytes(), int(wide[-1])
            at = at.tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in (ROW, "_source", "_deal")),
                    pa.array([b - a for a, b in zip(at, at[1:])], pa.int64()),
                    pa.array([blob[size * a : size * b] for a, b in zip(at, at[1:])], pa.binary()),
                ],
                names=[ROW, "_source", "_deal", "_n", "_ids"],
            )

    return run


def fill_windows(owed: np.ndarray, share: np.ndarray, queue: np.ndarray, capacities: list[int], quantum: int) -> list[tuple[int, int, int]]:
    """(window, source, tokens) of every serving; ``owed`` are the deficits to begin with.

    The capacities add up to the tokens in the queues, so that all are empty at the end.
    """
    owed, queue = owed.astype(float).copy(), queue.astype(np.int64).copy()
    n, turn, served = len(queue), 0, []
    for window, capacity in enumerate(capacities):
        owed += share * capacity
        order = np.roll(np.arange(n), -turn)
        want = np.minimum(np.maximum(np.floor(owed), 0).astype(np.int64), queue)
        want[want < np.minimum(quantum, queue)] = 0
        room, taken = capacity, np.zeros(n, np.int64)
        while room:
            before = np.cumsum(want[order]) - want[order]
            take = np.zeros(n, np.int64)
            take[order] = np.clip(room - before, 0, want[order])
            taken += take
            queue -= take
            room -= int(take.sum())
            if not room:
                turn = int(order[np.flatnonzero(take[order])[-1]]) + 1  # the next window begins after the last one served
            else:  # another round: what is left of the window by the shares of those that still have tokens
                able = queue > 0
                weight = np.where(able, np.maximum(share, 1e-12), 0)
                want = np.minimum(np.maximum(np.ceil(room * weight / weight.sum()), quantum).astype(np.int64), queue)
                # those owed most come first
                order = np.argsort(-(owed - taken), kind="stable")
        owed -= taken
        served += [(window, int(s), int(taken[s])) for s in np.flatnonzero(taken)]
    return served


def capacities(tokens: int, length: int) -> list[int]:
    """Full windows, and powers of two for the rest."""
    rest = tokens % length
    return [length] * (tokens // length) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def _pack_part(schema: pa.Schema, length: int, quantum: int, with_ids: bool):
    def run(key: tuple, documents: pa.Table, deficits: pa.Table) -> pa.Table:
        documents = documents.combine_chunks()
        if not documents.num_rows:
            return schema.empty_table()
        plan = {s: (d, p) for s, d, p in zip(*(deficits.column(c).to_pylist() for c in ("_source", "owed", "share")))}
        order = documents.sort_by([("_source", "ascending"), ("_order", "ascending")])
        sources = order.column("_source").to_pylist()
        counts = order.column("_n").to_numpy()
        ends = np.cumsum(counts)
        begins = ends - counts
        labels = list(dict.fromkeys(sources))
        number = {s: k for k, s in enumerate(labels)}
        of_source = np.array([number[s] for s in sources])
        queue = np.bincount(of_source, counts, len(labels)).astype(np.int64)
        owed, share = (np.array([plan[s][k] for s in labels], float) for k in (0, 1))
        sizes = capacities(int(ends[-1]), length)
        served = np.array(fill_windows(owed, share, queue, sizes, quantum), np.int64)
        window, source, tokens = served.T
        offset = np.cumsum(tokens) - tokens
        offset -= np.concatenate(([0], np.cumsum(sizes)))[window]
        by = np.argsort(source, kind="stable")  # in a source's queue, in the order of the windows
        at = np.cumsum(tokens[by]) - tokens[by]
        cuts = np.union1d(at, begins)
        sizes_ = np.diff(np.append(cuts, ends[-1]))
        serving = np.searchsorted(at, cuts, "right") - 1
        document = np.searchsorted(begins, cuts, "right") - 1
        width = 2 if len(order.column("_ids")[0].as_py()) == 2 * int(counts[0]) else 4
        ids = np.frombuffer(b"".join(order.column("_ids").to_pylist()), f"<u{width}").astype("<u4")
        coded = memoryview(ids.tobytes())
        crc = [zlib.crc32(coded[4 * a : 4 * (a + n)]) for a, n in zip(cuts.tolist(), sizes_.tolist())]
        columns = [
            order.column(ROW).combine_chunks().take(pa.array(document)),
            pa.array(cuts - begins[document], pa.int64()),
            pa.array(sizes_, pa.int64()),
            pa.array(crc, pa.int64()),
            pa.array(counts[document], pa.int64()),
            pa.array((key[0].as_py() << 32) + window[by][serving], pa.int64()),
            pa.array(offset[by][serving] + cuts - at[serving], pa.int64()),
        ]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(cuts, ends[-1]), pa.int32()), pa.array(ids.astype(np.int32))))
        give_back()
        return pa.table(columns, names=schema.names)

    return run


def _running(counts: DataFrame, shares: dict | None) -> DataFrame:
    """(_part, _source, owed, share): what each source of a part is owed when the part begins.

    Running totals over parts go by stretches of ``STRETCH`` parts first, so no task sees all parts.
    """
    earlier = lambda *by: Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    of_part = counts.groupBy("_part").agg(F.sum("n").alias("all")).withColumn("stretch", F.floor(F.col("_part") / STRETCH))
    stretches = of_part.groupBy("stretch").agg(F.sum("all").alias("sum"), F.min("_part").alias("_part"))
    before = F.coalesce(F.sum("sum").over(earlier()), F.lit(0)).alias("before")
    within = F.coalesce(F.sum("all").over(earlier("stretch")), F.lit(0))
    of_part = of_part.join(stretches.select("stretch", before), "stretch").select("_part", (F.col("before") + within).alias("all"))
    whole = counts.groupBy("_source").agg(F.sum("n").alias("whole"))
    if shares is None:
        total = counts.agg(F.sum("n")).first()[0] or 1
        whole = whole.select("_source", (F.col("whole") / total).alias("share"))
    else:
        given = F.lit(0.0)
        for source, value in shares.items():
            given = F.when(F.col("_source").eqNullSafe(F.lit(source)), F.lit(value / sum(shares.values()))).otherwise(given)
        whole = whole.select("_source", given.alias("share"))
    had = F.coalesce(F.sum("n").over(earlier("_source")), F.lit(0)).alias("had")
    owed = counts.select("_part", "_source", had).join(of_part, "_part").join(whole, "_source")
    return owed.select("_part", "_source", (F.col("share") * F.col("all") - F.col("had")).alias("owed"), "share")


def pack(
    documents: DataFrame,
    tokenizer: bytes,
    pattern: str,
    *,
    shares: dict[str, float] | None = None,
    length: int = LENGTH,
    quantum: int = QUANTUM,
    end: int = 1,
    text: str = "text",
    source: str = "source",
    order: str = "doc_id",
    keep: tuple[str, ...] = ("doc_id",),
    part_tokens: int = PART_TOKENS,
    with_ids: bool = True,
) -> DataFrame:
    """Every document's ids, closed by the id ``end``, in pieces of sequences of ``length`` tokens.

    A row is a piece: the ``keep`` columns of its document, ``start`` (ids of the document before it), ``length``,
    ``ids_crc32`` of the ids as little-endian 32-bit integers, ``doc_tokens``, ``sequence_id``, ``offset`` in the
    sequence, and ``ids``. Offsets in a sequence have no gaps. Sequences hold ``length`` tokens, or at the
    end of a part a smaller power of two. ``shares`` are the target proportions by source (a source that is
    not named gets what the others leave); by default each source's share of all tokens.

    A null text counts as empty and has the closing id only; null sources are one source more; rows of one
    id are documents of their own; an empty table gives no pieces; other columns are dropped unless kept.
    Within a source, a part's documents are queued by ``order``. Parts are chosen by the hash of ``order`` and
    text; rows that agree in both, or lack the id, are dealt out by their place in the input.
    """
    spark = documents.sparkSession
    file = spark.sparkContext.broadcast(tokenizer)
    place = F.when(named(order).isNull(), F.monotonically_increasing_id())
    source_rows = with_row(
        documents,
        keep,
        _text=named(text),
        _source=F.coalesce(named(source).cast("string"), F.lit("\x00")),
        _deal=F.xxhash64(named(order), named(text), place),
    )
    kept = row_schema(source_rows, "_source string, _deal long, _n long, _ids binary")
    tokens = settle(source_rows.mapInArrow(_tokenise(file, pattern, end), kept))
    total = tokens.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    parts = ceil(total / part_tokens) or 1
    tokens = tokens.withColumn("_part", F.pmod("_deal", F.lit(parts)).cast("int")).withColumnRenamed("_deal", "_order")
    counts = settle(tokens.groupBy("_part", "_source").agg(F.sum("_n").alias("n")))
    named_shares = None if shares is None else {("\x00" if s is None else s): v for s, v in shares.items()}
    deficits = _running(counts, named_shares)
    made = row_schema(tokens, PIECES + ", ids array<int>" * with_ids)
    packed = tokens.groupBy("_part").cogroup(deficits.groupBy("_part")).applyInArrow(
        _pack_part(to_arrow_schema(made), length, quantum, with_ids), made
    )
    return opened(packed)
