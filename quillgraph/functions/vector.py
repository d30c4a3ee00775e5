"""Vector similarity as expressions over double arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


#: Score where higher is nearer, by metric name.
METRICS = {"cosine": cosine, "dot": dot, "euclid": lambda a, b: -euclid(a, b), "manhattan": lambda a, b: -manhattan(a, b)}


def name_of(name: str | None) -> str:
    """Unknown names fall back to cosine."""
    return (name or "").lower() if (name or "").lower() in METRICS else "cosine"


def metric(name: str | None):
    return METRICS[name_of(name)]


# The same over matrices, a row a vector.


def prepared(rows: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows ready for ``scores``, normalised once where the metric asks for it, and which of them have a score: finite ones, and for
    cosine of some length."""
    sound = np.isfinite(rows).all(axis=1)
    if metric != "cosine":
        return rows, sound
    with np.errstate(over="ignore", invalid="ignore"):
        length = np.sqrt(np.einsum("ij,ij->i", rows, rows))
        sound &= np.isfinite(length) & (length > 0)
        return rows / np.where(sound, length, 1)[:, None], sound


def scores(rows: np.ndarray, queries: np.ndarray, metric: str, cells: int = 1_000_000) -> np.ndarray:
    """Scores of prepared rows against prepared queries."""
    if metric in ("cosine", "dot"):
        return rows @ queries.T
    out = np.empty((len(rows), len(queries)))
    step = max(1, cells // max(1, queries.size))
    for at in range(0, len(rows), step):
        gap = rows[at : at + step, None, :] - queries[None]
        out[at : at + step] = -np.sqrt(np.einsum("ijk,ijk->ij", gap, gap)) if metric == "euclid" else -np.abs(gap).sum(axis=2)
    return out
