"""Exact percentiles in a few passes, whatever the number of different values."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A bracket that holds at most so many values is sorted by one task.
SORTED_AT_ONCE = 200_000
#: Accuracy of the sketches, and the steps at which they are asked: a bracket shrinks to a hundredth of its values at least
#: with each pass.
ACCURACY = 2_000
_STEPS = 400
_STEP = 1 / _STEPS


def _interpolated(low: Any, high: Any, share: float) -> float | None:
    return None if low is None else float(low) + (float(high) - float(low)) * share


def exact_percentiles(df: DataFrame, wanted: dict[str, tuple[Column, list[float]]]) -> dict[str, list[float | None]]:
    """For each name, the percentiles (0 to 1, between neighbours linear) of a numeric expression, nulls left out.

    An exact percentile keeps every different value in one task. Instead, each rank is enclosed in a bracket of
    values: a sketch (mergeable, of bounded size) gives bounds, the next pass counts what lies below and within, exactly,
    and sketches what lies within again. A bracket of few values is sorted, one of equal bounds is done. All brackets of
    all expressions share each pass, so a table is read four to six times for any
    number of rows, and twice if it has few.
    """
    first = []
    for i, (c, shares) in enumerate(wanted.values()):
        around = sorted({min(1.0, max(0.0, s + d)) for s in shares for d in (-_STEP, _STEP)})
        first += [F.count(c).alias(f"n{i}"), F.min(c).alias(f"low{i}"), F.max(c).alias(f"high{i}"), F.percentile_approx(c, [*around], ACCURACY).alias(f"q{i}")]
    if not first:
        return {}
    row = df.agg(*first).first()
    ranks: dict[tuple[int, int], Any] = {}  # (expression, rank): value
    open_: dict[tuple[int, int], tuple] = {}  # ... : (low, high, low is left out, high is left out)
    places: dict[str, list[tuple[int, int, float] | None]] = {}
    for i, (name, (_, shares)) in enumerate(wanted.items()):
        n, places[name] = row[f"n{i}"], []
        around = sorted({min(1.0, max(0.0, s + d)) for s in shares for d in (-_STEP, _STEP)})
        for s in shares:
            if not n:
                places[name].append(None)
                continue
            at = s * (n - 1)
            low, high = math.floor(at), math.ceil(at)
            places[name].append((low, high, at - low))
            below = [q for x, q in zip(around, row[f"q{i}"], strict=True) if x <= s - _STEP]
            above = [q for x, q in zip(around, row[f"q{i}"], strict=True) if x >= s + _STEP]
            open_[i, low] = open_[i, high] = (max(below, default=row[f"low{i}"]), min(above, default=row[f"high{i}"]), False, False)
    columns = [c for c, _ in wanted.values()]
    bounds = [(row[f"low{i}"], row[f"high{i}"]) for i in range(len(columns))]

    def within(i: int, bracket: tuple) -> Column:
        c, (low, high, after, before) = columns[i], bracket
        return F.when((c > F.lit(low) if after else c >= F.lit(low)) & (c < F.lit(high) if before else c <= F.lit(high)), c)

    def sort(small: dict[tuple, list[tuple[int, int]]]) -> None:
        if not small:
            return
        parts = [F.percentile(within(i, x), F.array(*[F.lit((rank - below) / (count - 1) if count > 1 else 0.0) for _, rank in keys])).alias(f"p{k}") for k, ((i, x, below, count), keys) in enumerate(small.items())]
        row = df.agg(*parts).first()
        for k, keys in enumerate(small.values()):
            ranks.update(zip(keys, row[f"p{k}"], strict=True))

    few: dict[tuple, list[tuple[int, int]]] = {}
    for key in list(open_):
        if row[f"n{key[0]}"] <= SORTED_AT_ONCE:
            few.setdefault((key[0], (*bounds[key[0]], False, False), 0, row[f"n{key[0]}"]), []).append(key)
            del open_[key]
    sort(few)
    while open_:
        brackets = list(dict.fromkeys((i, x) for (i, _), x in open_.items()))
        aggregates = []
        for k, (i, x) in enumerate(brackets):
            under = columns[i] <= F.lit(x[0]) if x[2] else columns[i] < F.lit(x[0])
            aggregates += [F.count_if(under).alias(f"below{k}"), F.count(within(i, x)).alias(f"within{k}"), F.percentile_approx(within(i, x), [j / _STEPS for j in range(_STEPS + 1)], ACCURACY).alias(f"q{k}")]
        row = df.agg(*aggregates).first()
        told = {b: (row[f"below{k}"], row[f"within{k}"], row[f"q{k}"]) for k, b in enumerate(brackets)}
        small: dict[tuple, list[tuple[int, int]]] = {}
        for key, x in list(open_.items()):
            (i, rank), (low, high, after, before) = key, x
            below, count, q = told[i, x]
            if rank < below:  # the sketch's bound was off
                open_[key] = (bounds[i][0], low, False, not after)
            elif rank >= below + count:
                open_[key] = (high, bounds[i][1], not before, False)
            elif low == high:
                ranks[key] = low
                del open_[key]
            elif count <= SORTED_AT_ONCE:
                small.setdefault((i, x, below, count), []).append(key)
                del open_[key]
            else:
                share = (rank - below) / count
                a = max([v for j, v in enumerate(q) if j / _STEPS <= share - _STEP], default=low)
                b = min([v for j, v in enumerate(q) if j / _STEPS >= share + _STEP], default=high)
                new = (a, b, after and a == low, before and b == high)
                # a bracket that doesn't shrink has few different values: ask for one of its own
                v = q[round(share * _STEPS)]
                open_[key] = (v, v, False, False) if new == x else new
        sort(small)
    return {name: [None if p is None else _interpolated(ranks[i, p[0]], ranks[i, p[1]], p[2]) for p in places[name]] for i, name in enumerate(wanted)}
