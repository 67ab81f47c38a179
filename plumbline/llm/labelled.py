"""Labelled rows, bounded samples of them, and the fitting that the classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def training_labels(labels: DataFrame, label: str, modulus: int, held_out: int, most: int | None, id_col: str = "doc_id") -> DataFrame:
    """All labelled rows (or at most ``most``) whose crc32(id as text) mod ``modulus`` isn't ``held_out``: if bounded, those of the least
    hashes of their id, so every input size gives a sample of one law. Rows without id or with a label other than 0
    and 1 are left out; of rows that share an id the least label counts."""
    own = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).where("id is not null and y in (0, 1)")
    kept = own.where(F.crc32(F.col("id").cast("string").cast("binary")) % modulus != held_out)
    each = kept.groupBy("id").agg(F.min("y").alias("y"))
    return each if most is None else each.orderBy(F.xxhash64("id"), "id").limit(most)


def held_out(id_col: str, modulus: int, remainder: int):
    """Whether an id is in the held-out fold (a null id isn't)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def best_cut(scores: np.ndarray, y: np.ndarray) -> float:
    """The cut between two scores with the best balanced accuracy; in a gap, its middle."""
    order = np.argsort(scores, kind="stable")
    s, t = scores[order], y[order]
    ones, zeros = max(1, int(t.sum())), max(1, int((1 - t).sum()))
    below0, below1 = np.cumsum(1 - t) / zeros, np.cumsum(t) / ones
    gain = np.where(np.append(s[1:] > s[:-1], False), below0 - below1, -1.0)
    if not len(s) or gain.max() <= 0:
        return float(s[0]) - 1.0 if len(s) else 0.0
    top = np.flatnonzero(gain >= gain.max() - 1e-12)
    at = int(top[len(top) // 2])
    return float((s[at] + s[at + 1]) / 2)
