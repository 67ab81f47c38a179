"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import materialise

_NUMPY_LIMIT = 10**9


def draw_hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement are good; populations past numpy's limit by inversion."""
    if good + bad < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, n)) if n and good else 0
    low, high, total = max(0, n - bad), min(n, good), good + bad
    if low == high:
        return low
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    wide = int(12 * (n * (good / total) * (bad / total) * max(1, total - n) / total) ** 0.5) + 60
    first, last = max(low, mode - wide), min(high, mode + wide)
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.cumsum(np.exp(logs - logs.max()))
    return first + int(np.searchsorted(mass, rng.random() * mass[-1], side="right"))


def draw_from_urns(rng: np.random.Generator, urns: np.ndarray, n: int) -> np.ndarray:
    """A multivariate hypergeometric draw: how many of ``n`` come from each urn."""
    total = int(urns.sum())
    if total < _NUMPY_LIMIT:
        return rng.multivariate_hypergeometric(urns, n, method="marginals")
    if len(urns) == 1:
        return np.array([n], np.int64)
    half = len(urns) // 2
    left = draw_hypergeometric(rng, int(urns[:half].sum()), int(urns[half:].sum()), n)
    return np.concatenate([draw_from_urns(rng, urns[:half], left), draw_from_urns(rng, urns[half:], n - left)])


def matrix_row(before: np.ndarray, capacity: np.ndarray, at: int, seed: int) -> np.ndarray:
    """Row ``at`` of the matrix: rows that partition ``at`` sends to each target block.

    ``before`` holds the rows before each partition, and their total at its end. The matrix is drawn down a
    binary tree over the partitions, each node seeded by its range, so every task draws its own row in
    log2(partitions) steps, rows and columns sum exactly, and a repeated task draws the same row.
    """
    low, high, left = 0, len(before) - 1, np.asarray(capacity, np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        part = draw_from_urns(np.random.default_rng([seed, low, high]), left, int(before[middle] - before[low]))
        if at < middle:
            left, high = part, middle
        else:
            left, low = left - part, middle
    return left


def block_sizes(rows: int, shards: int, per_shard: int) -> np.ndarray:
    """Rows of each target block: ``per_shard`` blocks a shard; shard counts, and blocks of a shard, at most one apart."""
    sizes = [rows // shards + (s < rows % shards) for s in range(shards)]
    return np.array([(j + 1) * q // per_shard - j * q // per_shard for q in sizes for j in range(per_shard)], np.int64)


def shard_uniformly(docs: DataFrame, shards: int, seed: int = 17, block_rows: int = 65_536, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """``docs`` with the shard and the slot of each row, a uniformly random arrangement with shard counts at most one apart.

    Rows get a fixed (partition, position) when they are written once to the shared folder. From the partitions'
    counts alone, each task draws its row of the communication matrix, permutes the target labels of its rows
    (the local permutation), the exchange brings the rows of a target block together, and a second permutation
    orders the block. A shard is as many blocks as keep one at ``block_rows`` rows, so no task holds a shard and
    slots are gapless: the start of the block plus the place in it. Only (partition, position) pairs pass through
    Python. No column is a key, so skew in the data doesn't matter; equal rows count one by one.

    Null values in any column, repeated rows and empty texts are rows like others; an empty table gives an
    empty result; input columns named as ``shard_col`` or ``slot_col`` are replaced.
    """
    kept = [c for c in docs.columns if c not in (shard_col, slot_col)]
    fixed = materialise(docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("kept"), F.monotonically_increasing_id().alias("rid")), "sharding")
    part, position = F.shiftright("rid", 33), F.col("rid").bitwiseAND(F.lit((1 << 33) - 1))
    counted = sorted(fixed.groupBy(part.alias("part")).count().collect())  # one number for each input partition
    parts = np.array([r[0] for r in counted], np.int64)
    before = np.concatenate([[0], np.cumsum([r[1] for r in counted])]).astype(np.int64)
    rows = int(before[-1])
    per_shard = max(1, -(-rows // (shards * block_rows)))
    shared = docs.sparkSession.sparkContext.broadcast((parts, before))

    @F.pandas_udf("long")
    def block(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        numbers, starts = shared.value
        capacity, held = block_sizes(rows, shards, per_shard), (None, None)
        for p, i in pairs:
            out = np.empty(len(p), np.int64)
            for number in p.unique():
                if held[0] != number:
                    at = int(np.searchsorted(numbers, number))
                    labels = np.repeat(np.arange(len(capacity)), matrix_row(starts, capacity, at, seed))
                    held = (number, np.random.default_rng([seed, 1 << 40, at]).permutation(labels))
                mask = (p == number).to_numpy()
                out[mask] = held[1][i[mask].to_numpy()]
            yield pd.Series(out)

    dealt = fixed.withColumn("block", block(part, position))
    rank = F.row_number().over(Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed), "rid"), "rid"))
    shard, in_shard = F.expr(f"block div {per_shard}"), F.expr(f"block % {per_shard}")
    size = F.lit(rows // shards) + F.when(shard < rows % shards, 1).otherwise(0)
    start = F.floor(in_shard * size / per_shard) if per_shard > 1 else F.lit(0)
    placed = dealt.select("kept", "block", rank.alias("rank"))
    return placed.select("kept.*", shard.cast("int").alias(shard_col), (start + F.col("rank") - 1).cast("long").alias(slot_col))
