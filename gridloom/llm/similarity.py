"""Jaccard self-join of documents on word shingles by chosen paths.

1. Documents of equal shingle sets become one class; everything after works on classes.
2. A class is sketched by the least hash in each of ``BINS`` bins (one-permutation MinHash). In each of
   ``RUNS`` runs, or more for classes on long paths, it follows about 1 / ``SIMILARITY`` of its tokens,
   chosen by a hash that all classes share, so similar classes choose the same tokens. A path is the
   sequence of tokens chosen so far.
3. Classes on one path meet in a bucket. Up to ``LEAF`` of them are compared pair by pair; a larger
   bucket is read once, compared with a few pivots, and what is not close to one of them goes on to
   longer paths. Classes whose sketches agree enough are coarsely linked.
4. Components of coarse links are compared exactly, on whole shingle sets, all pairs; large ones part
   against part.

Chance of meeting: a pair at the threshold shares one chosen token a run on average, and meets with
chance 0.63 on the first step, 0.47 after two and 0.37 after three; over 12 runs 0.99999, 0.9995 and
0.996. Classes that went further get as many more runs as their steps need for ``RECALL``. Sketches of
pairs at the threshold agree in 0.80 of the bins with a deviation of 0.05; the coarse border
of 0.45 lies seven deviations below. In a large bucket a class leaves with a pivot that it agrees with in 0.78; Jaccard distance is a metric, so whatever links to that class agrees with the pivot in
0.58 on average or more, and is coarsely linked to the pivot too.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gridloom.llm.components import connected_components
from gridloom.llm.repeats import _words_of, as_lines
from gridloom.llm.rows import named
from gridloom.llm.text import Rolling, flat_ranges, mix, pieces, utf8
from gridloom.llm.vectors import _labels
from gridloom.session import scratch_folder

SHINGLE_WORDS = 5
SIMILARITY = 0.8
RECALL = 0.996
RUNS = 12
BINS = 64
LEAF = 1_024
PIVOTS = 32
COARSE = 0.45
CLOSE = 0.78
MOST_STEPS = 40
MOST_IN_UNIT = 400
MOST_IN_PART = 1_000
SHINGLES_IN_PART = 500_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ordered by bin, and the n+1 offsets of the texts.

    A shingle is ``size`` consecutive words; a text of fewer words, but some, is one shingle.
    """
    symbols = _words_of(*as_lines(data, offsets))
    words = np.diff(symbols.offsets)
    counts = np.where(words > 0, np.maximum(words - size + 1, 1), 0)
    at = flat_ranges(symbols.offsets[:-1], counts)
    owner = np.repeat(np.arange(len(words)), counts)
    found = Rolling(symbols.codes).stretches(at, np.minimum(at + size, symbols.offsets[owner + 1]))
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[new], np.searchsorted(owner[new], np.arange(len(words) + 1))


def _chosen(path: np.ndarray, token: np.ndarray, filled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens continue a path, and the path they lead to."""
    lot = mix(token ^ mix(path))
    return lot < (2.0**64 / (SIMILARITY * np.maximum(filled, 2))).astype(np.uint64), mix(lot + np.uint64(0x9E37))


def runs_for(steps: int, recall: float) -> int:
    """Runs after which a pair at the threshold has stayed together for so many steps with chance ``recall``.

    It shares one chosen token a step on average, so the chances follow a branching process of mean one.
    """
    meet = 1.0
    for _ in range(steps):
        meet = 1 - exp(-meet)
    return ceil(log(1 - recall) / log(1 - meet))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches and first steps of the runs from ``given`` on and below ``wanted`` of each row, if it has them."""
    for batch in pieces(batches, "text"):
        hashes, cuts = shingle_sets(*utf8(batch.column("text")))
        n = batch.num_rows
        owner = np.repeat(np.arange(n), np.diff(cuts))
        sums = np.concatenate(([0], np.cumsum(hashes, dtype=np.uint64)))
        other = np.concatenate(([0], np.cumsum(mix(hashes ^ np.uint64(0xA5A5)), dtype=np.uint64)))
        bins = (hashes >> np.uint64(58)).astype(np.int64)
        first = np.ones(len(hashes), bool)
        first[1:] = (bins[1:] != bins[:-1]) | (owner[1:] != owner[:-1])
        sketch = np.zeros((n, BINS), np.uint8)
        token, row = hashes[first], owner[first]
        sketch[row, bins[first]] = 1 + mix(token) % np.uint64(255)
        filled = np.bincount(row, minlength=n)[row]
        paths, owners = [], []
        given, wanted = np.zeros(n, np.int64), np.full(n, RUNS)
        if "given" in batch.schema.names:
            given, wanted = (batch.column(c).to_numpy() for c in ("given", "wanted"))
        for run in range(given.min(initial=RUNS), wanted.max(initial=0)):
            mine = (given <= run) & (run < wanted)
            taken, path = _chosen(np.full(len(token), run + 1, np.uint64), token, filled)
            taken &= mine[row]
            paths.append(path[taken])
            owners.append(row[taken])
        path, whose = np.concatenate(paths), np.concatenate(owners)
        order = np.argsort(whose, kind="stable")
        ends = np.searchsorted(whose[order], np.arange(n + 1))
        flat = path[order].view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                pa.array(np.diff(cuts), pa.int64()),
                pa.array((sums[cuts[1:]] - sums[cuts[:-1]]).view(np.int64)),
                pa.array((other[cuts[1:]] - other[cuts[:-1]]).view(np.int64)),
                pa.array([x.tobytes() for x in sketch], pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
            ],
            names=["id", "n", "s1", "s2", "sketch", "paths"],
        )


SKETCHES = "id long, n long, s1 long, s2 long, sketch binary, paths array<long>"
STEP = "path long, rep long, other long, sketch binary"


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), BINS)


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the bins filled in either that hold the same, for all rows of a against all of b."""
    out = np.empty((len(a), len(b)))
    for k in range(len(b)):
        same = ((a == b[k]) & (b[k] > 0)).sum(axis=1)
        either = ((a > 0) | (b[k] > 0)).sum(axis=1)
        out[:, k] = same / np.maximum(either, 1)
    return out


def _step_rows(path: np.ndarray, rep: np.ndarray, other: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
    """Links (rep, other) first, then rows that go on along their paths."""
    a, b = len(other), len(path)
    nothing = [None] * a
    return pa.RecordBatch.from_arrays(
        [
            pa.array(nothing + path.view(np.int64).tolist(), pa.int64()),
            pa.array(rep, pa.int64()),
            pa.array(other.tolist() + [None] * b, pa.int64()),
            pa.array(nothing + [x.tobytes() for x in sketch], pa.binary()),
        ],
        names=["path", "rep", "other", "sketch"],
    )


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Before the shuffle: of classes on one path with the same sketch, all but the first are linked to it
    and stay behind. Everything after works on sketches, so the first one finds all that they would find;
    classes that are only close may not be left behind here, since heads differ from batch to batch."""
    for batch in batches:
        path = batch.column("path").to_numpy().view(np.uint64)
        rep, sketch = batch.column("rep").to_numpy(), _matrix(batch.column("sketch"))
        kind = np.unique(sketch.view(f"V{BINS}").ravel(), return_inverse=True)[1]
        order = np.lexsort((rep, kind, path))
        new = np.ones(len(order), bool)
        new[1:] = (path[order][1:] != path[order][:-1]) | (kind[order][1:] != kind[order][:-1])
        head = rep[order][new][np.cumsum(new) - 1]
        stay = order[new]
        yield _step_rows(path[stay], np.concatenate((rep[order][~new], rep[stay])), head[~new], sketch[stay])


class _Bucket:
    """One path as its rows stream by: kept whole up to ``LEAF`` rows, then only its pivots."""

    def __init__(self, path: int):
        self.path = path
        self.rep, self.sketch = np.zeros(0, np.int64), np.zeros((0, BINS), np.uint8)
        self.large = False
        self.links: list[tuple[np.ndarray, np.ndarray]] = []
        self.onward: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, rep: np.ndarray, sketch: np.ndarray) -> None:
        if not self.large:
            self.rep, self.sketch = np.concatenate((self.rep, rep)), np.concatenate((self.sketch, sketch))
            if len(self.rep) <= LEAF:
                return
            rep, sketch = self.rep, self.sketch
            self.rep, self.sketch = self.rep[:PIVOTS], self.sketch[:PIVOTS]
            self.large = True
        alike = agreement(sketch, self.sketch)
        level = alike.max(axis=1)
        agrees = alike >= COARSE
        linked = agrees.any(axis=1)
        # one link for each class, to the first pivot it agrees with, which is mostly the same on all
        # paths; and those between pivots that a class agrees with
        first = agrees.argmax(axis=1)
        i, k = np.nonzero(agrees)
        ends = np.unique(np.stack((self.rep[first[i]], self.rep[k])), axis=1)
        a, b = np.concatenate((rep[linked], ends[0])), np.concatenate((self.rep[first[linked]], ends[1]))
        self.links.append((a[a != b], b[a != b]))
        on = (level < CLOSE) | np.isin(rep, self.rep)
        rep, sketch = rep[on], sketch[on]
        i, j = np.nonzero(sketch)
        token = (j.astype(np.uint64) << np.uint64(8)) | sketch[i, j].astype(np.uint64)
        taken, path = _chosen(np.full(len(i), self.path, np.uint64), mix(token), (sketch > 0).sum(axis=1)[i])
        self.onward.append((path[taken], rep[i[taken]], sketch[i[taken]]))

    def close(self) -> None:
        if not self.large and len(self.rep) > 1:
            i, k = np.nonzero(np.triu(agreement(self.sketch, self.sketch) >= COARSE, 1))
            label = _labels(len(self.rep), i, k)
            told = np.flatnonzero(label != np.arange(len(label)))
            self.links.append((self.rep[told], self.rep[label[told]]))

    def drain(self) -> tuple[list, list]:
        links, onward, self.links, self.onward = self.links, self.onward, [], []
        return links, onward


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of a partition sorted by path, one after another."""
    open_: _Bucket | None = None
    for batch in batches:
        known = np.asarray(batch.column("path").is_valid())
        passed = batch.filter(pa.array(~known))
        batch = batch.filter(pa.array(known))
        links = [(passed.column("rep").to_numpy(), passed.column("other").to_numpy())]
        onward = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, BINS), np.uint8))]
        path = batch.column("path").to_numpy().view(np.uint64)
        rep, sketch = batch.column("rep").to_numpy(), _matrix(batch.column("sketch"))
        cuts = np.concatenate(([0], np.flatnonzero(path[1:] != path[:-1]) + 1, [len(path)]))
        worth = np.diff(cuts) > 1  # a class alone on its path meets nothing
        worth[[0, -1]] = len(path) > 0  # but the first and the last may belong to other batches
        for at in np.flatnonzero(worth).tolist():
            a, b = cuts[at], cuts[at + 1]
            if open_ is None or open_.path != path[a]:
                if open_ is not None:
                    open_.close()
                    got = open_.drain()
                    links += got[0]
                    onward += got[1]
                open_ = _Bucket(path[a])
            open_.add(rep[a:b], sketch[a:b])
        if open_ is not None:
            got = open_.drain()
            links += got[0]
            onward += got[1]
        yield _joint(links, onward)
    if open_ is not None:
        open_.close()
        links, onward = open_.drain()
        onward.append((np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, BINS), np.uint8)))
        links.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
        yield _joint(links, onward)


def _joint(links: list, onward: list) -> pa.RecordBatch:
    a, b = (np.concatenate(x) for x in zip(*links))
    path, rep, sketch = (np.concatenate(x) for x in zip(*onward))
    return _step_rows(path, np.concatenate((a, rep)), b, sketch)


def _first_runs(recall: float) -> int:
    return max(RUNS, runs_for(1, recall))


def _follow(classes: DataFrame, needed: list[int], first: int) -> tuple[DataFrame, DataFrame | None]:
    """Coarse links found along the paths of ``classes``, and the steps of those classes that go further than the
    ``first`` runs suffice for."""
    rows = classes.select(F.explode("paths").alias("path"), "rep", "sketch").mapInArrow(_combine, STEP)
    links, deep = None, None
    for step in range(1, MOST_STEPS + 1):
        dealt = rows.repartition(F.coalesce("path", "rep")).sortWithinPartitions(F.col("path").asc_nulls_first(), "rep")
        met = dealt.mapInArrow(_meet, STEP).checkpoint()
        found = met.filter("path is null").select(F.col("rep").alias("a"), F.col("other").alias("b"))
        links = found if links is None else links.unionByName(found)
        rows = met.filter("path is not null")
        if rows.isEmpty():
            return links, deep
        if needed[step + 1] > first:
            further = rows.select("rep").distinct().select("rep", F.lit(step + 1).alias("steps"))
            deep = further if deep is None else deep.unionByName(further)
    raise RuntimeError(f"paths did not end in {MOST_STEPS} steps")


def _coarse_links(classes: DataFrame, source: DataFrame, recall: float) -> DataFrame:
    """Coarse links of all classes. After the first runs, classes on long paths get as many more as bring a
    pair that stays together for as many steps to ``recall``, until none has gone further than its runs allow."""
    needed = [0, *(runs_for(k, recall) for k in range(1, MOST_STEPS + 2))]
    first = _first_runs(recall)
    links, deep = _follow(classes, needed, first)
    had = None
    while deep is not None:
        steps = deep.groupBy("rep").agg(F.max("steps").alias("steps"))
        wanted = steps.select("rep", F.array(*map(F.lit, needed))[F.col("steps")].cast("long").alias("wanted"))
        if had is None:
            more = wanted.withColumn("given", F.lit(first).cast("long"))
        else:
            more = wanted.join(had, "rep", "left").withColumn("given", F.coalesce("had", F.lit(RUNS)).cast("long"))
        more = more.filter("wanted > given").checkpoint()
        if more.isEmpty():
            break
        sketched = source.join(more.withColumnRenamed("rep", "id"), "id").mapInArrow(_sketch, SKETCHES)
        again = sketched.groupBy(F.col("id").alias("rep")).agg(F.any_value("paths").alias("paths"), F.any_value("sketch").alias("sketch"))
        found, deep = _follow(again, needed, first)
        links = links.unionByName(found)
        now = more.select("rep", F.col("wanted").alias("had"))
        had = (now if had is None else had.unionByName(now)).groupBy("rep").agg(F.max("had").alias("had")).checkpoint()
    return links


def _shared(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarity of each set with each other one, by inverted index over the others."""
    out = np.zeros((len(sets), len(others)))
    if not sets or not others:
        return out
    joint, where = np.unique(np.concatenate(others), return_inverse=True)
    sizes = np.array([len(x) for x in others])
    table = np.zeros((len(joint), len(others)), np.float32)
    table[where, np.repeat(np.arange(len(others)), sizes)] = 1
    for k, x in enumerate(sets):
        at = np.searchsorted(joint, x)
        at = at[at < len(joint)]
        hit = at[np.isin(joint[at], x, assume_unique=True)] if len(at) else at
        both = table[hit].sum(axis=0)
        out[k] = both / np.maximum(len(x) + sizes - both, 1)
    return out


def _sets(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    hashes, cuts = shingle_sets(*utf8(column))
    return [hashes[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


LINKED = "rep long, links long, least long"


def _verify(similarity: float):
    """All pairs of each cluster in a partition sorted by cluster; one row for each linked class."""

    def one(rep: np.ndarray, copies: np.ndarray, texts: pa.Array, out: list) -> None:
        rep, first = np.unique(rep, return_index=True)
        copies, texts = copies[first], texts.take(pa.array(first))
        sets = _sets(texts)
        i, j = np.nonzero(np.triu(_shared(sets, sets) >= similarity, 1))
        if len(i):
            links = np.bincount(i, copies[j], len(rep)) + np.bincount(j, copies[i], len(rep))
            label = _labels(len(rep), i, j)
            told = np.flatnonzero(links)
            out.append((rep[told], links[told].astype(np.int64), rep[label[told]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.concat_batches([held, batch])
            cluster = batch.column("cluster").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cluster)) + 1).tolist()]
            held = batch.slice(cuts[-1])
            yield from rows(batch, cuts)
        if held is not None:
            yield from rows(held, [0, held.num_rows])

    def rows(batch: pa.RecordBatch, cuts: list[int]) -> Iterator[pa.RecordBatch]:
        out: list = []
        rep, copies = batch.column("rep").to_numpy(), batch.column("copies").to_numpy()
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                one(rep[a:b], copies[a:b], batch.column("text").slice(a, b - a), out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["rep", "links", "least"])

    return run


def _shared_by_parts(x: np.ndarray, of_x: np.ndarray, a: int, y: np.ndarray, of_y: np.ndarray, b: int) -> np.ndarray:
    """How many hashes each of ``a`` sets shares with each of ``b`` others, from the hashes and their sets.

    Only hashes on both sides are looked at: those in many sets by products of matrices, the others pair by pair.
    """
    out = np.zeros(a * b)
    joint = np.intersect1d(x, y)
    if not len(joint):
        return out.reshape(a, b)
    held = []
    for hashes, of in ((x, of_x), (y, of_y)):
        at = np.searchsorted(joint, hashes)
        known = joint[np.minimum(at, len(joint) - 1)] == hashes
        order = np.argsort(at[known], kind="stable")
        counts = np.bincount(at[known], minlength=len(joint))
        held.append((of[known][order], np.cumsum(counts) - counts, counts))
    (of_x, from_x, n_x), (of_y, from_y, n_y) = held
    pairs = n_x * n_y
    often, seldom = np.flatnonzero(pairs > a * b // 128), np.flatnonzero(pairs <= a * b // 128)
    for k in range(0, len(often), 4_096):
        some = often[k : k + 4_096]
        sides = []
        for of, start, n, size in ((of_x, from_x, n_x, a), (of_y, from_y, n_y, b)):
            table = np.zeros((size, len(some)), np.float32)
            table[of[flat_ranges(start[some], n[some])], np.repeat(np.arange(len(some)), n[some])] = 1
            sides.append(table)
        out += (sides[0] @ sides[1].T).ravel()
    for some in np.split(seldom, np.flatnonzero(np.diff(np.cumsum(pairs[seldom]) // 2_000_000)) + 1):
        times = np.repeat(n_y[some], n_x[some])
        i = np.repeat(of_x[flat_ranges(from_x[some], n_x[some])], times)
        j = of_y[flat_ranges(np.repeat(from_y[some], n_x[some]), times)]
        out += np.bincount(i * b + j, minlength=a * b)
    return out.reshape(a, b)


def _as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        sets = pa.array([x.tobytes() for x in _sets(batch.column("text"))], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in SETS[:-1]), sets], names=SETS)


SETS = ["cluster", "rep", "copies", "n", "shingles"]
UNIT = ["cluster", "low", "first", "second", "across"]


def _compare(similarity: float):
    """Links inside one unit: one part of a large cluster, or two parts of it. Only sums for each class
    and one edge to the least class of its piece leave the unit, not the pairs."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        first, second, across = (x.as_py() for x in key[2:])
        rep, once = np.unique(table.column("rep").to_numpy(), return_index=True)
        copies, upper = (table.column(c).to_numpy()[once] for c in ("copies", "upper"))
        column = table.column("shingles").combine_chunks().take(pa.array(once)).to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in column]
        sizes = np.array([len(x) for x in sets])
        alone = first == second and not across
        sides = [np.flatnonzero(~upper), np.flatnonzero(~upper if alone else upper)]
        if not all(map(len, sides)):
            i = j = np.zeros(0, np.int64)
        else:
            flat = [(np.concatenate([sets[k] for k in side]), np.repeat(np.arange(len(side)), sizes[side]), len(side)) for side in sides]
            both = _shared_by_parts(*flat[0], *flat[1])
            alike = both / np.maximum(sizes[sides[0]][:, None] + sizes[sides[1]] - both, 1) >= similarity
            i, j = np.nonzero(np.triu(alike, 1) if alone else alike)
            i, j = sides[0][i], sides[1][j]
        links = np.bincount(i, copies[j], len(rep)) + np.bincount(j, copies[i], len(rep))
        label = _labels(len(rep), i, j)
        told = np.flatnonzero(links)
        return pa.table([pa.array(x, pa.int64()) for x in (rep[told], links[told].astype(np.int64), rep[label[told]])], names=["rep", "links", "least"])

    return run


def _large_clusters(members: DataFrame, similarity: float) -> DataFrame:
    """All links of clusters of more than ``MOST_IN_UNIT`` classes, exactly, in one pass of part against part.

    Members are told apart by the logarithm of the size of their sets: linked sets lie in one band or
    in neighbouring ones. A band is cut by id into parts of bounded size; each pair of parts of one band or
    of two neighbouring bands is a unit of its own.
    """
    width = max(-log(similarity), 0.01) * 1.001  # a little more, so that rounding cannot put linked sets two bands apart
    banded = members.withColumn("band", F.floor(F.log("n") / width).cast("int"))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / MOST_IN_PART, F.sum("n") / SHINGLES_IN_PART)).cast("int")
    bands = banded.groupBy("cluster", "band").agg(blocks.alias("blocks"))
    along = Window.partitionBy("cluster").orderBy("band")
    for name, there, step in (("before", F.lag, -1), ("after", F.lead, 1)):
        near = there("band").over(along) == F.col("band") + step
        bands = bands.withColumn(name, F.when(near, there("blocks").over(along)).otherwise(0))
    sets = banded.select(*SETS[:-1], "text").mapInArrow(_as_sets, "cluster long, rep long, copies long, n long, shingles binary")
    sets = sets.withColumn("band", F.floor(F.log("n") / width).cast("int")).join(bands, ["cluster", "band"])
    units = F.expr("""explode(concat(
        transform(sequence(0, blocks - 1), o -> named_struct(
          'low', band, 'first', least(side, o), 'second', greatest(side, o), 'across', false, 'upper', side > o)),
        transform(filter(sequence(0, after), o -> o < after), o -> named_struct(
          'low', band, 'first', side, 'second', o, 'across', true, 'upper', false)),
        transform(filter(sequence(0, before), o -> o < before), o -> named_struct(
          'low', band - 1, 'first', o, 'second', side, 'across', true, 'upper', true))))""")
    dealt = sets.withColumn("side", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).withColumn("unit", units)
    dealt = dealt.select("cluster", "unit.*", "rep", "copies", "shingles")
    return dealt.groupBy(*UNIT).applyInArrow(_compare(similarity), LINKED)


def similar_documents(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links) for each row.

    Two documents are linked if the Jaccard similarity of their sets of shingles of five words (runs of
    characters other than space and 0x09-0x0D, unchanged) is ``similarity`` or more. ``class_id`` is the
    least doc_id reachable over links. ``n_links`` counts the documents found to be linked directly,
    copies included.

    A pair exactly at ``similarity`` is found with chance ``recall``, whatever number of steps its paths take.

    Null and empty texts have no shingles and link with nothing; a text of one to four words is one
    shingle; documents without an id link with nothing and have a null class; repeated rows are copies
    of each other (rows that share an id should share its text); an empty table gives an empty result; other columns are not read.
    """
    scratch_folder(documents.sparkSession)
    source = documents.select(named(doc_id).cast("long").alias("id"), named(text).alias("text"))
    sketched = source.withColumns({"given": F.lit(0).cast("long"), "wanted": F.lit(_first_runs(recall)).cast("long")}).mapInArrow(_sketch, SKETCHES)
    by_set = ["s1", "s2", "n"]
    ids = sketched.select("id", *by_set, "sketch", "paths").checkpoint()
    whole = ids.filter("n > 0 and id is not null")
    classes = whole.groupBy(*by_set, "sketch", "paths").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = classes.select("rep", "copies", *by_set, "sketch", "paths").checkpoint()

    clusters = connected_components(_coarse_links(classes, source, recall)).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    members = classes.select("rep", "copies", "n").join(clusters, "rep")
    texts = source.filter("id is not null").withColumnRenamed("id", "rep")
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    members = members.join(sizes, "cluster").withColumn("large", F.col("size") > MOST_IN_UNIT).checkpoint()
    whole_texts = members.join(texts, "rep").select("cluster", "rep", "copies", "n", "text", "large")
    if members.filter("large").isEmpty():
        small = whole_texts
        linked = None
    else:
        whole_texts = whole_texts.checkpoint()
        small = whole_texts.filter("not large")
        linked = _large_clusters(whole_texts.filter("large").drop("large"), similarity)
    dealt = small.select("cluster", "rep", "copies", "text").repartition("cluster").sortWithinPartitions("cluster")
    verified = dealt.mapInArrow(_verify(similarity), LINKED)
    linked = verified if linked is None else linked.unionByName(verified)
    linked = linked.checkpoint()

    links = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    reached = connected_components(linked.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    told = (
        classes.join(links, "rep", "left")
        .join(reached.withColumnRenamed("node", "rep"), "rep", "left")
        .select(*by_set, F.coalesce("component", "rep").alias("class"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    )
    usable = F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("n"))
    joined = ids.select("id", "s1", "s2", usable.alias("n")).join(told, by_set, "left")
    return joined.select(
        F.col("id").alias(doc_id),
        F.coalesce("class", "id").alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
    )


def brute_force(documents: list[tuple[int, str | None]], similarity: float = SIMILARITY) -> dict[int, tuple[int, int]]:
    """(class_id, n_links) of each document, from all pairs that share a shingle."""
    sets = {}
    for d, t in documents:
        words = (t or "").encode().split()
        sets[d] = {tuple(words[i : i + SHINGLE_WORDS]) for i in range(max(1, len(words) - SHINGLE_WORDS + 1))} if words else set()
    holders: dict[tuple, list[int]] = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    both: dict[tuple[int, int], int] = {}
    for d, s in sets.items():
        for x in s:
            for e in holders[x]:
                if e < d:
                    both[e, d] = both.get((e, d), 0) + 1
    pairs = [p for p, n in both.items() if n / (len(sets[p[0]]) + len(sets[p[1]]) - n) >= similarity]
    ids = sorted(sets)
    place = {d: i for i, d in enumerate(ids)}
    i, j = (np.array([place[p[k]] for p in pairs], int) for k in (0, 1))
    label = _labels(len(ids), i, j)
    links = np.bincount(np.concatenate((i, j)), minlength=len(ids))
    return {d: (ids[label[k]], int(links[k])) for k, d in enumerate(ids)}
