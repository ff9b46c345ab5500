"""Similarity of vectors as Columns: higher is better for every metric.

cosine (1 + cos) / 2, euclidean 1 / (1 + d * d), dot (1 + dot) / 2.  A score
that isn't defined (a zero vector under cosine, a null) is null and never a hit.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("COSINE", "EUCLIDEAN", "DOT_PRODUCT")
#: Dimensions up to which a literal query is unrolled into generated code; beyond, higher-order functions fold the arrays.
UNROLL = 128


def _fold(v: Column, q: Column, term) -> Column:
    return F.aggregate(F.zip_with(v, q, lambda x, y: term(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def _sum(v: Column, query: Sequence[float], term) -> Column:
    if len(query) > UNROLL:
        return _fold(v, F.array(*[F.lit(float(x)) for x in query]), term)
    return reduce(lambda s, x: s + x, [term(F.get(v, F.lit(i)).cast("double"), F.lit(float(x))) for i, x in enumerate(query)], F.lit(0.0))


def score(vector: Column, query: Sequence[float] | Column, metric: str = "COSINE") -> Column:
    """The score of a vector column against a literal query or another column."""
    if metric not in METRICS:
        raise ValueError(f"no such metric: {metric}")
    add = (lambda term: _fold(vector, query, term)) if isinstance(query, Column) else (lambda term: _sum(vector, query, term))
    if metric == "EUCLIDEAN":
        return 1 / (1 + add(lambda x, y: (x - y) * (x - y)))
    dot = add(lambda x, y: x * y)
    if metric == "DOT_PRODUCT":
        return (1 + dot) / 2
    own = add(lambda x, y: x * x)
    other = add(lambda x, y: y * y) if isinstance(query, Column) else F.lit(float(np.dot(np.asarray(query, float), np.asarray(query, float))))
    return (1 + F.try_divide(dot, F.sqrt(own * other))) / 2


def scores(vectors: np.ndarray, queries: np.ndarray, metric: str = "COSINE") -> np.ndarray:
    """The same for blocks: vectors by queries, NaN where undefined."""
    dot = vectors @ queries.T
    if metric == "DOT_PRODUCT":
        return (1 + dot) / 2
    own, other = (vectors * vectors).sum(1)[:, None], (queries * queries).sum(1)[None, :]
    if metric == "EUCLIDEAN":
        return 1 / (1 + np.maximum(own + other - 2 * dot, 0))
    with np.errstate(invalid="ignore", divide="ignore"):
        return (1 + dot / np.sqrt(own * other)) / 2


def row_scores(vectors: np.ndarray, query: np.ndarray, metric: str = "COSINE") -> np.ndarray:
    """The same for one query; equal vectors have equal scores to the last bit, wherever they stand."""
    if metric == "EUCLIDEAN":
        return 1 / (1 + ((vectors - query) ** 2).sum(1))
    dot = (vectors * query).sum(1)
    if metric == "DOT_PRODUCT":
        return (1 + dot) / 2
    with np.errstate(invalid="ignore", divide="ignore"):
        return (1 + dot / np.sqrt((vectors * vectors).sum(1) * (query * query).sum())) / 2


def rounded(x: np.ndarray, decimals: int) -> np.ndarray:
    """Halves go away from zero, as in SQL; np.round takes them to even."""
    with np.errstate(over="ignore", invalid="ignore"):
        y = x * 10.0**decimals
        whole = np.trunc(y)
        out = (whole + np.copysign(np.abs(y - whole) >= 0.5, y)) / 10.0**decimals
    return np.where(np.isfinite(out), out, x)
