"""ST8 by nearest neighbours: mutual information of continuous columns without bins.

The estimate compares, around every row, the distance to its k-th neighbour in the plane of
feature and target (larger of the two coordinate differences) with the rows that lie as close
on one axis alone. Only distinct points with their counts are kept. Points are cut by
(x, y) into stripes of about the square root of their number; an x with more points than that
has stripes of its own, which are short in y. A point's neighbours inside its stripe bound its
distance, and only the stripes that this distance reaches are asked again. Rows per axis come
from running totals over ordered slices. So no task holds a column, whatever value is frequent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.functions.joins import join_null_safe
from gridloom.functions.numeric import finite, ratio
from gridloom.operators.series import POS, SLICE, SeriesKey, slice_rows, with_positions
from gridloom.session import settle

STRIPE_POINTS = 2048
QUERY_ROWS = 200_000
WINDOW = 32
CANDIDATES = 2_000_000
INSIDE = 1 - 1e-9
POINT = "feature INT, _pos BIGINT, x DOUBLE, y DOUBLE, w BIGINT, near ARRAY<DOUBLE>, visits ARRAY<BIGINT>"


def digamma(n: Column) -> Column:
    """Digamma of a positive number: six steps of its recurrence, then the asymptotic series."""
    z = n + F.lit(6.0)
    q = F.lit(1.0) / (z * z)
    series = F.log(z) - F.lit(0.5) / z - q * (F.lit(1 / 12) - q * (F.lit(1 / 120) - q * (F.lit(1 / 252) - q / 240)))
    for step in range(6):
        series = series - F.lit(1.0) / (n + F.lit(float(step)))
    return series


def closest(
    points: tuple[np.ndarray, np.ndarray, np.ndarray],
    x: np.ndarray,
    y: np.ndarray,
    start: np.ndarray,
    stop: np.ndarray,
    k: int,
    own: np.ndarray | None = None,
) -> np.ndarray:
    """The k smallest distances from each query to points start to stop, copies counted, padded by infinity.

    ``own`` is the query's own place among the points; one row of it is the query itself.
    """
    px, py, pw = points
    found = np.full((len(x), k), np.inf)
    ends = np.cumsum(stop - start)
    done = 0
    while done < len(x):
        reached = ends[done - 1] if done else 0
        until = max(done + 1, int(np.searchsorted(ends, reached + CANDIDATES, "right")))
        n = (stop - start)[done:until]
        q = np.repeat(np.arange(done, until), n)
        at = np.arange(len(q)) + np.repeat(start[done:until] - np.cumsum(n) + n, n)
        d = np.maximum(np.abs(px[at] - x[q]), np.abs(py[at] - y[q]))
        w = pw[at] if own is None else pw[at] - (at == own[q])
        order = np.lexsort((d, q))
        q, d, w = q[order], d[order], np.minimum(w[order], k)
        before = np.cumsum(w) - w
        heads = np.flatnonzero(np.diff(q, prepend=-1))
        before -= np.repeat(before[heads], np.diff(heads, append=len(q)))
        room = np.clip(k - before, 0, w)
        column = np.arange(room.sum()) + np.repeat(before - np.cumsum(room) + room, room)
        found[np.repeat(q, room), column] = np.repeat(d, room)
        done = until
    return found


def _within(points: tuple, x: np.ndarray, y: np.ndarray, bound: np.ndarray, k: int, own=None) -> np.ndarray:
    """``closest`` among the points, ordered by y, that are no farther in y than the bound."""
    wide = bound * (2 - INSIDE)
    start = np.searchsorted(points[1], y - wide, "left")
    stop = np.maximum(start, np.searchsorted(points[1], y + wide, "right"))
    return closest(points, x, y, start, stop, k, own)


class Boxes:
    """The extents of a feature's stripes, in order, and which of them a square around a point meets.

    Stripes of one frequent x form a run that is searched by y; there are about as many
    stripes as a stripe has points.
    """

    def __init__(self, table: pd.DataFrame):
        table = table.sort_values("stripe")
        self.stripe, self.rows = table["stripe"].to_numpy(), table["rows"].to_numpy()
        self.x0, self.x1, self.y0, self.y1 = (table[c].to_numpy() for c in ("x0", "x1", "y0", "y1"))
        flat = self.x0 == self.x1
        joined = flat[1:] & flat[:-1] & (self.x0[1:] == self.x0[:-1])
        self.heads = np.flatnonzero(np.r_[True, ~joined])
        self.tails = np.r_[self.heads[1:], len(table)]

    def bound(self, x: float, y: float, k: int) -> float:
        """A distance within which some stripe has k points."""
        full = self.rows >= k
        if not full.any():
            return np.inf
        sides = [np.abs(x - self.x0), np.abs(x - self.x1), np.abs(y - self.y0), np.abs(y - self.y1)]
        return float(np.max(sides, axis=0)[full].min()) * (2 - INSIDE)

    def met(self, x: np.ndarray, y: np.ndarray, bound: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of (query, stripe) other than the own stripe."""
        head_x0, head_x1 = self.x0[self.heads], self.x1[self.heads]
        first = np.searchsorted(head_x1, x - bound, "right")
        last = np.maximum(first, np.searchsorted(head_x0, x + bound, "left"))
        n = last - first
        q = np.repeat(np.arange(len(x)), n)
        run = np.arange(len(q)) + np.repeat(first - np.cumsum(n) + n, n)
        queries, places = [], []
        for r in np.unique(run):
            asked, h, t = q[run == r], self.heads[r], self.tails[r]
            low = np.searchsorted(self.y1[h:t], y[asked] - bound[asked], "right")
            n = np.maximum(0, np.searchsorted(self.y0[h:t], y[asked] + bound[asked], "left") - low)
            queries.append(np.repeat(asked, n))
            places.append(np.arange(n.sum()) + np.repeat(h + low - np.cumsum(n) + n, n))
        if not queries:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        asked, stripes = np.concatenate(queries), self.stripe[np.concatenate(places)]
        other = stripes != own
        return asked[other], stripes[other]


def _inside_stripe(boxes: dict[int, Boxes], k: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Nearest distances inside one stripe, and the other stripes that must be asked."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("y", kind="stable").reset_index(drop=True)
        x, y, w = (rows[c].to_numpy() for c in ("x", "y", "w"))
        place, size = np.arange(len(rows)), len(rows)
        start, stop = np.maximum(0, place - WINDOW), np.minimum(size, place + WINDOW + 1)
        near = closest((x, y, w), x, y, start, stop, k, place)
        bound = near[:, -1]
        below = np.where(start > 0, y - y[np.maximum(start - 1, 0)], np.inf)
        above = np.where(stop < size, y[np.minimum(stop, size - 1)] - y, np.inf)
        open_ = np.flatnonzero(np.minimum(below, above) < bound)
        if len(open_):
            near[open_] = _within((x, y, w), x[open_], y[open_], bound[open_], k, open_)
        box, bound = boxes[key[0]], near[:, -1].copy()
        for i in np.flatnonzero(np.isinf(bound)):
            bound[i] = box.bound(x[i], y[i], k)
        asked, stripes = box.met(x, y, bound, key[1])
        order = np.argsort(asked, kind="stable")
        cuts = np.searchsorted(asked[order], np.arange(1, size))
        rows = rows.assign(near=list(near), visits=np.split(stripes[order], cuts), reach=bound)
        return rows[["feature", POS, "x", "y", "w", "near", "visits", "reach"]]

    return run


def _other_stripe(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("y", kind="stable")
        held = tuple(points[c].to_numpy() for c in ("x", "y", "w"))
        near = _within(held, *(queries[c].to_numpy() for c in ("x", "y", "reach")), k)
        return pd.DataFrame({"feature": queries["feature"], POS: queries[POS], "near": list(near)})

    return run


def _stripe_numbers(frequent: dict[int, np.ndarray], size: dict[int, int]) -> Callable:
    """Number points by (frequent x passed, slice of positions), so that no stripe mixes a frequent x with others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            stripe = np.zeros(len(rows), np.int64)
            for f in rows["feature"].unique():
                own = (rows["feature"] == f).to_numpy()
                x, heavy = rows["x"].to_numpy()[own], frequent.get(f, np.empty(0))
                passed = np.searchsorted(heavy, x, "left") + np.searchsorted(heavy, x, "right")
                stripe[own] = (passed.astype(np.int64) << 32) + rows[POS].to_numpy()[own] // size[f]
            yield rows.assign(stripe=stripe)

    return run


def reaches(points: DataFrame, k: int, stripe_points: int = STRIPE_POINTS) -> DataFrame:
    """Add ``reach``, the distance to the k-th nearest row, to distinct points (feature, x, y, w)."""
    numbered = settle(with_positions(points, SeriesKey(("feature",), ("x", "y"))).select("feature", "x", "y", "w", POS))
    counts = {r["feature"]: r["n"] for r in numbered.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = {f: max(stripe_points, 8 * int(n**0.5)) for f, n in counts.items()}
    limit = F.create_map(*[F.lit(v) for pair in size.items() for v in pair])
    many = numbered.groupBy("feature", "x").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit[F.col("feature")])
    frequent = {f: np.sort(g["x"].to_numpy()) for f, g in many.toPandas().groupby("feature")}
    schema = "feature INT, x DOUBLE, y DOUBLE, w BIGINT, _pos BIGINT, stripe BIGINT"
    placed = settle(numbered.mapInPandas(_stripe_numbers(frequent, size), schema))
    extents = placed.groupBy("feature", "stripe").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
        F.least(F.sum("w"), F.lit(1 << 40)).alias("rows"),
    )
    boxes = {f: Boxes(g) for f, g in extents.toPandas().groupby("feature")}
    first = settle(placed.groupBy("feature", "stripe").applyInPandas(_inside_stripe(boxes, k), POINT + ", reach DOUBLE"))
    asked = first.select("feature", F.explode("visits").alias("stripe"), POS, "x", "y", "reach")
    load = asked.groupBy("feature", "stripe").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("parts"))
    load = F.broadcast(settle(load))  # at most one row per stripe
    queries = asked.join(load, ["feature", "stripe"]).withColumn("part", (F.col(POS) % F.col("parts")).cast("int"))
    held = placed.join(load, ["feature", "stripe"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    by = ["feature", "stripe", "part"]
    answers = queries.select(*by, POS, "x", "y", "reach").groupBy(*by).cogroup(
        held.select(*by, "x", "y", "w").groupBy(*by)
    ).applyInPandas(_other_stripe(k), "feature INT, _pos BIGINT, near ARRAY<DOUBLE>")
    crossing = F.size("visits") > 0
    merged = (
        first.where(crossing).select("feature", POS, "near").unionByName(answers).groupBy("feature", POS)
        .agg(F.sort_array(F.flatten(F.collect_list("near")))[k - 1].alias("joint"))
    )
    return first.join(merged, ["feature", POS], "left").select(
        "feature", POS, "x", "y", "w", F.coalesce("joint", "reach").alias("reach")
    )


def _rows_within(reached: DataFrame) -> DataFrame:
    """Per point the rows ``nx`` and ``ny`` that are closer than its reach on one axis, itself included."""
    axes = F.array(F.struct(F.lit(0).alias("axis"), F.col("x").alias("v")), F.struct(F.lit(1).alias("axis"), F.col("y").alias("v")))
    values = reached.select("feature", F.inline(axes), "w").groupBy("feature", "axis", "v").agg(F.sum("w").alias("w"))
    values = values.select(
        "feature", "axis", "v", F.lit(0).alias("side"), F.lit(-1).cast("long").alias(POS), "w",
        F.lit(0).cast("long").alias("own"), F.lit(False).alias("tied"),
    )
    near = F.col("reach") * INSIDE
    ends = F.array(*[
        F.struct(F.lit(a).alias("axis"), (F.col(c) + near * side).alias("v"), F.lit(side).alias("side"))
        for a, c in enumerate(("x", "y")) for side in (-1, 1)
    ])
    limits = reached.select(
        "feature", F.inline(ends), POS, F.lit(0).cast("long").alias("w"), F.col("w").alias("own"), (F.col("reach") == 0).alias("tied")
    )
    key = SeriesKey(("feature", "axis"), ("v", "side", POS))
    lines = values.unionByName(limits.select(values.columns))
    lines = slice_rows(lines, key, lines.count())
    totals = lines.groupBy("feature", "axis", SLICE).agg(F.sum("w").alias("rows"))
    earlier = Window.partitionBy("feature", "axis").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("feature", "axis", SLICE, F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"))
    running = F.sum("w").over(key.forward(SLICE).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    below = join_null_safe(lines, offsets, ["feature", "axis", SLICE]).withColumn("below", F.col("offset") + running)
    signed = F.col("side") * F.col("below")
    return below.where(F.col("side") != 0).groupBy("feature", POS).agg(
        F.sum(F.when(F.col("axis") == 0, signed)).alias("nx"),
        F.sum(F.when(F.col("axis") == 1, signed)).alias("ny"),
        F.max("own").alias("w"),
        F.max("tied").alias("tied"),
    )


def neighbour_information(
    df: DataFrame, features: list[str], target: str, k: int = 5, stripe_points: int = STRIPE_POINTS
) -> DataFrame:
    """ST8: (feature, mi_score, mi_normalized) in nats by k nearest neighbours, exact for any number of rows.

    Columns are divided by their standard deviation. Rows with a NULL, NaN or infinity in a named
    column are left out. Where k or more copies of a row exist, its neighbours are its copies.
    Negative estimates become 0; with k rows or fewer the score is NULL.
    """
    names = list(dict.fromkeys([*features, target]))
    known = df.select(*[F.col(c).cast("double").alias(c) for c in names])
    for c in names:
        known = known.where(finite(c))
    facts = known.agg(F.count(F.lit(1)).alias("_rows"), *[F.stddev_pop(c).alias(c) for c in names]).first()
    n = facts["_rows"]
    labels = df.sparkSession.createDataFrame(list(enumerate(features)), "number INT, feature STRING")
    if n <= k:
        unknown = F.lit(None).cast("double")
        return labels.select("feature", unknown.alias("mi_score"), unknown.alias("mi_normalized"))
    scaled = {c: F.col(c) / F.lit(facts[c] or 1.0) for c in names}
    listed = F.array(*[
        F.struct(F.lit(i).alias("feature"), scaled[f].alias("x"), scaled[target].alias("y")) for i, f in enumerate(features)
    ])
    points = known.select(F.inline(listed)).groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("w"))
    around = _rows_within(settle(reaches(points, k, stripe_points)))
    local = digamma(F.when(F.col("tied"), F.col("w")).otherwise(F.lit(k))) - digamma(F.col("nx")) - digamma(F.col("ny"))
    scores = around.groupBy(F.col("feature").alias("number")).agg(
        F.greatest(F.lit(0.0), F.sum(F.col("w") * local) / F.lit(n) + digamma(F.lit(n))).alias("mi_score")
    )
    best = F.max("mi_score").over(Window.partitionBy(F.lit(0)))
    return scores.join(labels, "number").select("feature", "mi_score", ratio(F.col("mi_score"), best).alias("mi_normalized"))
