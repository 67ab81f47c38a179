"""Quality scores from Bradley-Terry pairwise ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, meet, slices, tidy
from plumbline.llm.near_dedup import _P, word_hashes
from plumbline.llm.labelled import held_out, sigmoid, training_labels
from plumbline.operators.percentiles import exact_percentiles

FEATURES = ("words", "chars", "word_length", "distinct", "distinct_law", "repeats", "top_word", "top_three", "bars", "exclaimed", "symbols", "digits", "upper", "capitalised", "stops", "commas", "lines", "same_lines", "short", "long", "marked", "brackets", "alike_pairs", "letters", "line_length")
_IS = {name: np.isin(np.arange(256), list(which.encode())) for name, which in {"symbols": "#$%&*@^~=+<>{}[]\\_", "digits": "0123456789", "space": " \t\n\r\x0b\x0c"}.items()}
_IS["letters"] = np.array([65 <= x <= 90 or 97 <= x <= 122 or x >= 192 for x in range(256)])  # of other alphabets: first bytes
_IS["characters"] = np.array([x < 128 or x >= 192 for x in range(256)])


def features(texts: list[str | None]) -> np.ndarray:
    """A row of measures of form for each whole text, none of its vocabulary; zeros for one without words. Characters
    are counted by classes of UTF-8 bytes, words by 64-bit hashes."""
    raws = [t.encode() if t else b"" for t in texts]
    out = np.zeros((len(texts), len(FEATURES)))
    for row, text, raw, h in zip(out, texts, raws, word_hashes(raws), strict=True):
        n = len(h)
        if not n:
            continue
        byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        held = {k: int(byte[v].sum()) for k, v in _IS.items()}
        chars, bare = held["characters"], max(1, held["characters"] - held["space"])
        counts = np.sort(np.unique(h, return_counts=True)[1])[::-1]
        pairs = len(np.unique(h[:-1] * _P + h[1:])) if n > 1 else 0
        words = text.split()
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        lines = [x for x in raw.split(b"\n") if x]
        row[:] = (
            np.log1p(n), np.log1p(chars), bare / n, len(counts) / n, np.log1p(len(counts)) / np.log1p(n), (h[1:] == h[:-1]).sum() / n, counts[0] / n, counts[:3].sum() / n,
            byte[124] / n, byte[33] / n, held["symbols"] / n, held["digits"] / chars, sum(map(str.isupper, words)) / n, sum(map(str.istitle, words)) / n, byte[46] / n, byte[44] / n,
            len(lines) / n, 1 - len(set(lines)) / max(1, len(lines)), (lengths < 3).sum() / n, (lengths > 15).sum() / n, (raw.count(b"http") + byte[64]) / n, (byte[40] + byte[60] + byte[123]) / n,
            1 - pairs / max(1, n - 1), held["letters"] / bare, np.log1p(chars / max(1, len(lines))),
        )
    return out


#: Width of the cells in which scores are gathered: sums over pairs are off by a hundred-thousandth a pair at most.
_CELL = 1 / 32


def _standardised(x: np.ndarray, middle: np.ndarray, spread: np.ndarray) -> np.ndarray:
    z = np.clip((x - middle) / spread, -6, 6)
    return np.concatenate([z, z * z], axis=1)


@dataclass
class BradleyTerry:
    """Scores of documents, ``weights`` on standardised features and their squares; ``cut`` is the score quantile
    ``quantile`` of the labelled rows, and ``steep`` the slope by which scores become shares."""

    middle: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float
    quantile: float
    steep: float
    level: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        return _standardised(x, self.middle, self.spread) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; ``level`` exactly at the cut."""
        return sigmoid(self.steep * (self.latent(x) - self.cut) + np.log(self.level / (1 - self.level)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = 40_000, ridge: float = 1e-3, level: float = 0.7, quantile: float | None = None, seed: int = 5) -> BradleyTerry:
    """Learn scores of rows at hand (``train`` takes all pairs of tables) from ``pairs`` preference pairs, one document of label 1 over one of label 0, by the logistic
    loss of feature differences (Newton steps with a ridge). The cut is a quantile of the sample's scores: ``quantile``, or
    the share of label 0 there. Without both labels all scores are ``level``."""
    middle, spread = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    model = BradleyTerry(middle, spread, np.zeros(2 * len(middle)), 0.0, 0.0, 1.0, level)
    ones, zeros = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(ones) or not len(zeros):
        return model
    rng = np.random.default_rng(seed)
    z = _standardised(x, middle, spread)
    d = z[rng.choice(ones, pairs)] - z[rng.choice(zeros, pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(25):
        p = sigmoid(d @ w)
        gradient = d.T @ (p - 1) / pairs + ridge * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w
    s = model.latent(x)
    model.quantile = float((y == 0).mean()) if quantile is None else quantile
    order = np.sort(s)
    at = model.quantile * len(s)
    low, high = order[max(0, min(len(s) - 1, int(np.ceil(at)) - 1))], order[min(len(s) - 1, int(np.ceil(at)))]
    model.cut = float((low + high) / 2)
    model.steep = float(1.0 / (np.abs(s - model.cut).mean() / 2 + 1e-9))
    return model


def _measured(docs: DataFrame, extra: str, kept: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text", 1 << 20):
                x = pa.array([v.tobytes() for v in features(rows.column("text").to_pylist())], pa.binary())
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), x], names=[*kept, "x"])

    return docs.mapInArrow(tidy(run), f"{extra}, x binary")


def _summed(rows: DataFrame, add: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of what ``add`` gives of some labels and features: an array of ``size``, one from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += add(*_arrays(batch)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    return sum((np.frombuffer(r["part"]) for r in rows.mapInArrow(tidy(run), "part binary").collect()), np.zeros(size))


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("y").to_numpy(), np.frombuffer(b"".join(batch.column("x").to_pylist())).reshape(-1, len(FEATURES))


def _cells(rows: DataFrame, model: BradleyTerry) -> list[tuple[np.ndarray, np.ndarray]]:
    """For label 0 and label 1: scores at the edges of cells, and the number and sums of standardised features of the rows
    there; a row counts at both edges of its cell, at the nearer more."""
    names = [f"v{i}" for i in range(2 * len(FEATURES) + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, x = _arrays(batch)
            z = _standardised(x, model.middle, model.spread)
            at = z @ model.weights / _CELL
            edge = np.floor(at).astype(np.int64)
            values = np.concatenate([np.ones((len(z), 1)), z], axis=1)
            both = np.concatenate([values * (1 - at + edge)[:, None], values * (at - edge)[:, None]])
            keys, place = np.unique(np.concatenate([edge, edge + 1]) * 2 + np.tile(y, 2), return_inverse=True)
            sums = [np.bincount(place, c, len(keys)) for c in both.T]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *map(pa.array, sums)], names=["key", *names])

    made = rows.mapInArrow(tidy(run), "key long, " + ", ".join(f"{n} double" for n in names))
    table = np.array(made.groupBy("key").agg(*[F.sum(n) for n in names]).orderBy("key").collect(), float)
    return [(np.floor(part[:, 0] / 2) * _CELL, part[:, 1:]) for part in (table[table[:, 0] % 2 == y] for y in (0, 1))]


def _newton(rows: DataFrame, model: BradleyTerry, ridge: float) -> np.ndarray:
    """The step of the weights from the logistic loss of all pairs of a row of label 1 and one of label 0. Of a pair only the
    difference of scores counts, so each row meets the cells of the other label, and no table of pairs arises."""
    size = 2 * len(FEATURES)
    (at0, held0), (at1, held1) = _cells(rows, model)
    wrong0, wrong1, curve0, curve1 = np.zeros(len(at0)), np.zeros(len(at1)), np.zeros(len(at0)), np.zeros(len(at1))
    across = np.zeros((size, size))
    for low in range(0, len(at1), 256):
        part = slice(low, low + 256)
        wrong = sigmoid(at0[None, :] - at1[part, None])
        curve = wrong * (1 - wrong)
        wrong1[part], curve1[part] = wrong @ held0[:, 0], curve @ held0[:, 0]
        wrong0 += held1[part, 0] @ wrong
        curve0 += held1[part, 0] @ curve
        across += held1[part, 1:].T @ (curve @ held0[:, 1:])

    def squares(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        z = _standardised(x, model.middle, model.spread)
        s = z @ model.weights
        return (z * np.where(y == 1, np.interp(s, at1, curve1), np.interp(s, at0, curve0))[:, None]).T @ z

    pairs = held0[:, 0].sum() * held1[:, 0].sum()
    gradient = (wrong0 @ held0[:, 1:] - wrong1 @ held1[:, 1:]) / pairs + ridge * model.weights
    own = _summed(rows, squares, size * size).reshape(size, size)
    return np.linalg.solve((own - across - across.T) / pairs + ridge * np.eye(size), gradient)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, fold: int = 2, id_col: str = "doc_id", text_col: str = "text", ridge: float = 1e-3, level: float = 0.7) -> BradleyTerry:
    """Fit on all labelled documents outside the held-out fold: Newton steps of the loss of all their preference pairs; the
    cut is the quantile of all their scores at the share of label 0. The features stay in a scratch table (200 bytes a
    document), which each step reads twice; sums alone reach the driver, which don't grow with the input. Weights are
    rounded, as sums hang on the order of rows in their last digits. Without both labels all scores are ``level``."""
    key = F.col(f"`{id_col}`")
    learned = docs.select(key.alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where(key.isNotNull() & ~held_out(f"`{id_col}`", modulus, fold))
    measured = _measured(learned, f"id {learned.schema['id'].dataType.simpleString()}", ["id"])
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(meet(measured, training_labels(labels, label, modulus, fold, None, id_col), "id").select("y", "x"), "labelled")
    size = len(FEATURES)
    n, ones, *sums = _summed(rows, lambda y, x: np.concatenate([[len(y), y.sum()], x.sum(axis=0)]), size + 2)
    middle = np.round(np.array(sums) / max(1, n), 9)
    spread = np.round(np.sqrt(_summed(rows, lambda _, x: ((x - middle) ** 2).sum(axis=0), size) / max(1, n)), 9) + 1e-6
    model = BradleyTerry(middle, spread if n else np.ones(size), np.zeros(2 * size), 0.0, 0.0, 1.0, level)
    if 0 < ones < n:
        for _ in range(25):
            step = _newton(rows, model, ridge)
            model.weights = model.weights - step
            if np.abs(step).max() < 1e-5:
                break
        model.weights = np.round(model.weights, 9)

        def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(model.latent(_arrays(batch)[1]))], names=["s"])

        latent = scratch.keep(rows.mapInArrow(tidy(scores), "s double"), "latent")
        model.quantile = float((n - ones) / n)
        # as many rows are below the cut as have label 0: between two ranks, of 0 to n - 1
        model.cut = exact_percentiles(latent, {"cut": (F.col("s"), [(n - ones - 0.5) / (n - 1)])})["cut"][0]
        model.steep = float(1.0 / (round(latent.agg(F.avg(F.abs(F.col("s") - model.cut))).first()[0], 9) / 2 + 1e-9))
        scratch.drop("latent")
    scratch.drop("labelled")
    return model


def score_quality(docs: DataFrame, model: BradleyTerry, id_col: str = "doc_id", text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``, in one map over whole texts. Null and empty texts have the features of no words
    and get a score by them; other columns pass through, one named as the score is replaced."""
    kept = [c for c in docs.columns if c != score_col]
    schema = docs.select(*[f"`{c}`" for c in kept]).schema
    spelled = schema.toDDL() if kept else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, text_col, 1 << 20):
                x = features(rows.column(text_col).to_pylist())
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), pa.array(model.score(x), pa.float64())], names=[*kept, score_col])

    return docs.select(*[f"`{c}`" for c in kept]).mapInArrow(tidy(run), f"{spelled}, `{score_col}` double")


__all__ = ["BradleyTerry", "features", "fit", "held_out", "score_quality", "train"]
