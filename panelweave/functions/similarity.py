"""String similarity in [0, 1]."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .formats import as_column

# Winkler bonus per common leading character, and how many count.
PREFIX_BONUS = 0.1
MAX_PREFIX = 4


def levenshtein_similarity(left, right) -> Column:
    """1 - distance / longer length, ignoring case; two empty strings give 1."""
    left, right = as_column(left), as_column(right)
    longest = F.greatest(F.length(left), F.length(right))
    distance = F.levenshtein(F.lower(left), F.lower(right))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.lit(1.0) - distance / longest)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(left: pd.Series, right: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity, ignoring case; halves of transpositions count.

    Pairs of a batch are matched side by side, one left character at a time, as
    rows of code points.  The helpers are nested so that they travel with the
    function: workers need not have the package.
    """

    def codes(texts: list[str], width: int) -> np.ndarray:
        """Code points as rows, filled up with zeros."""
        raw = b"".join(t.ljust(width, "\0").encode("utf-32-le") for t in texts)
        return np.frombuffer(raw, dtype="<u4").reshape(len(texts), width)

    def similarity(lefts: list[str], rights: list[str]) -> np.ndarray:
        m, n = (np.array([len(t) for t in texts]) for texts in (lefts, rights))
        a, b = codes(lefts, max(int(m.max()), 1)), codes(rights, max(int(n.max()), 1))
        reach = np.maximum(np.maximum(m, n) // 2 - 1, 0)
        place = np.arange(b.shape[1])
        free = place < n[:, None]
        paired = np.zeros(a.shape, dtype=bool)
        for at in range(a.shape[1]):
            near = free & (b == a[:, at : at + 1]) & (np.abs(place - at) <= reach[:, None]) & (at < m)[:, None]
            row = np.flatnonzero(near.any(axis=1))
            free[row, near[row].argmax(axis=1)] = False
            paired[row, at] = True
        taken = ~free & (place < n[:, None])
        common = paired.sum(axis=1)
        # Paired characters of both sides in order, side by side.
        width = max(int(common.max()), 1)
        first = np.take_along_axis(a, np.argsort(~paired, axis=1, kind="stable")[:, :width], axis=1)
        second = np.take_along_axis(b, np.argsort(~taken, axis=1, kind="stable")[:, :width], axis=1)
        swapped = ((first != second) & (np.arange(width) < common[:, None])).sum(axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            jaro = (common / m + common / n + (common - swapped / 2) / common) / 3
        jaro = np.where(common > 0, jaro, 0.0)
        head = min(MAX_PREFIX, a.shape[1], b.shape[1])
        same = (a[:, :head] == b[:, :head]) & (np.arange(head) < np.minimum(m, n)[:, None])
        lead = np.logical_and.accumulate(same, axis=1).sum(axis=1)
        same_text = np.array([x == y for x, y in zip(lefts, rights)])
        return np.where(same_text, 1.0, jaro + lead * PREFIX_BONUS * (1 - jaro))

    low, high = left.str.lower(), right.str.lower()
    out = np.full(len(low), np.nan)
    known = np.flatnonzero((low.notna() & high.notna()).to_numpy())
    lefts, rights = low.to_numpy(dtype=object)[known], high.to_numpy(dtype=object)[known]
    sizes = np.array([max(len(x), len(y)) for x, y in zip(lefts, rights)], dtype=int)
    order, at = np.argsort(sizes, kind="stable"), 0
    while at < len(order):  # about a million characters at once, of like lengths
        stop = at + 1
        while stop < len(order) and (stop + 1 - at) * sizes[order[stop]] <= 1 << 20:
            stop += 1
        chosen = order[at:stop]
        out[known[chosen]] = similarity(list(lefts[chosen]), list(rights[chosen]))
        at = stop
    return pd.Series(out)
