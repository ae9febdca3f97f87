"""Counting crossed pairs inside one bounded group of points."""

from __future__ import annotations

import sys
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark import cloudpickle

# Ship these functions with the task, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def crossed_weight(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> int:
    """Sum of weight products over pairs with a_i < a_j and b_i > b_j.

    Rows are put in (a, b) order; then, for every power of two, pairs falling into the
    two halves of one block are counted by a sort on b and running sums.
    """
    n = len(a)
    if n < 2:
        return 0
    order = np.lexsort((b, a))
    b = np.unique(b[order], return_inverse=True)[1]
    total = sum(int(w) for w in weight)
    weight = weight[order].astype(np.int64 if total * total < 2**62 else object)
    place = np.arange(n)
    crossed = 0
    half = 1
    while half < n:
        block, right = place // (2 * half), (place // half) % 2 == 1
        sort = np.lexsort((right, b, block))
        w, is_right, blk = weight[sort], right[sort], block[sort]
        left = np.cumsum(np.where(is_right, 0, w))
        last = np.searchsorted(blk, blk, side="right") - 1
        crossed += int(np.sum(w[is_right] * (left[last[is_right]] - left[is_right])))
        half *= 2
    return crossed


def crossed_in_group(a: str, b: str, name: str | None = None):
    """Function for ``applyInPandas``; the result repeats the group's ``name`` column if asked."""

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        crossed = crossed_weight(rows[a].to_numpy(), rows[b].to_numpy(), rows["w"].to_numpy())
        out = {name: [rows[name].iloc[0]]} if name else {}
        return pd.DataFrame({**out, "crossed": [Decimal(crossed)]})

    return count
