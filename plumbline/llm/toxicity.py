"""Toxicity scores from a classifier that is regularised by counterfactuals."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import slices, tidy
from plumbline.llm.labelled import best_cut, sigmoid, training_labels

#: Terms that name groups of people; within a row, any may stand for any other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("disabled", "deaf", "blind", "old", "young"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)
PREFIXES = (4, 5, 6)
#: A feature counts at most so often in a text, in fitting as in scoring.
MOST = 3
_BITS = 20
_WORD = re.compile(r"[^\W\d_]+")


def sentence_words(text: str | None) -> set[str]:
    """The different words of a whole text, lower-cased."""
    return set(_WORD.findall(text.lower())) if text else set()


def word_features(word: str) -> list[int]:
    """A word counts as itself and as each of its longer beginnings, so that unseen forms of a known stem count."""
    made = [f"w{word}"] + [f"{n}{word[:n]}" for n in PREFIXES if len(word) > n]
    return [zlib.crc32(m.encode()) & ((1 << _BITS) - 1) for m in made]


@dataclass
class ToxicityModel:
    """``weights`` by feature; the score is a sum over the different words of a text, each feature at most ``MOST`` times."""

    weights: dict[int, float]
    cut: float = 0.0
    steep: float = 1.0
    level: float = 0.5
    known: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False)

    def features(self, word: str) -> tuple[int, ...]:
        """Those of a word that have a weight."""
        if word not in self.known:
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[word] = tuple(f for f in word_features(word) if f in self.weights)
        return self.known[word]

    def word(self, word: str) -> float:
        return sum(self.weights[f] for f in self.features(word))

    def latent(self, text: str | None) -> float:
        known, held = self.known, []
        for w in sentence_words(text):
            found = known.get(w)
            held += self.features(w) if found is None else found
        return math.fsum(self.weights[f] * min(n, MOST) for f, n in Counter(held).items())

    def score(self, latents: np.ndarray) -> np.ndarray:
        return sigmoid(self.steep * (latents - self.cut) + np.log(self.level / (1 - self.level)))


def counterfactuals(words: set[str], terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> list[tuple[str, str]]:
    """The swaps of a sentence: (its identity term, another of the group that it lacks)."""
    return [(t, other) for group in terms for t in group if t in words for other in group if other not in words]


def _listed(words: list[str] | str) -> list[str]:
    return words.split() if isinstance(words, str) else words


def fit(rows: list[tuple[list[str] | str, int]], terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, strength: float = 4.0, lasso: float = 2e-3, most_features: int = 6_000, rounds: int = 150, level: float = 0.5) -> ToxicityModel:
    """Learn from (different words, label) by logistic loss plus ``strength`` times the mean squared change of the
    score when an identity term of a labelled sentence is swapped for another of its group, and a lasso.

    Each label weighs half. Besides the swaps that the sentences give, each group's terms are swapped once in
    an empty sentence, so terms that no sentence holds are tied to the rest as well. Features are those that tell the
    labels apart most, and every feature of an identity term. The cut is that of the best balanced accuracy.
    """
    y = np.array([label for _, label in rows], np.float64)
    if not len(y) or y.min() == y.max():
        return ToxicityModel({}, level=level, cut=0.0 if not len(y) or y.max() == 0 else -1.0)
    dims = 1 << _BITS
    seen, found = np.zeros((2, dims)), []
    for words, label in rows:
        ids, n = np.unique(np.fromiter((f for w in _listed(words) for f in word_features(w)), np.int32), return_counts=True)
        found.append((ids, np.minimum(n, MOST).astype(np.uint8)))
        seen[label, ids] += 1
    n1, n0 = y.sum(), len(y) - y.sum()
    share = (seen[0] + seen[1] + 1) / (len(y) + 2)
    apart = np.abs(seen[1] / n1 - seen[0] / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    apart[seen.sum(axis=0) < 3] = 0
    chosen = set(np.argsort(-apart, kind="stable")[:most_features][apart[np.argsort(-apart, kind="stable")[:most_features]] > 0].tolist())
    chosen |= {f for group in terms for t in group for f in word_features(t)}
    place = {f: i for i, f in enumerate(sorted(chosen))}
    d, at = len(place), np.full(dims, -1, np.int32)
    at[list(place)] = list(place.values())
    kept = [at[ids] >= 0 for ids, _ in found]
    row = np.repeat(np.arange(len(found)), [k.sum() for k in kept])
    col = np.concatenate([at[ids[k]] for (ids, _), k in zip(found, kept, strict=True)])
    val = np.concatenate([n[k] for (_, n), k in zip(found, kept, strict=True)]).astype(np.float64)
    del found, kept
    swaps = Counter(s for words, _ in rows for s in counterfactuals(set(_listed(words)), terms))
    swaps.update((a, b) for group in terms for a in group for b in group if a < b)
    change = np.zeros((len(swaps), d), np.float32)
    often = np.array([np.sqrt(n) for n in swaps.values()], np.float32)
    for i, (a, b) in enumerate(swaps):
        for t, sign in ((a, -1), (b, 1)):
            for f in word_features(t):
                change[i, place[f]] += sign
    change *= (often / np.sqrt(max(1.0, float((often**2).sum()))))[:, None]
    touched = np.flatnonzero(np.abs(change).sum(axis=0) > 0)
    tied = change[:, touched].astype(np.float64)
    weigh = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    step = 1.0 / (0.25 * max(1.0, float(np.bincount(col, weigh[row] * val * val, d).max()) * 8) + 2 * strength * (np.linalg.norm(tied, 2) ** 2 if len(touched) else 0))
    w, bias, v, momentum = np.zeros(d), 0.0, np.zeros(d), 1.0
    for _ in range(rounds):
        p = sigmoid(np.bincount(row, v[col] * val, len(y)) + bias)
        r = weigh * (p - y)
        gradient = np.bincount(col, r[row] * val, d)
        if len(touched):
            gradient[touched] += 2 * strength * tied.T @ (tied @ v[touched])
        moved = v - step * gradient
        new = np.sign(moved) * np.maximum(0, np.abs(moved) - step * lasso)
        bias -= 1.0 * r.sum()
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        v = new + (momentum - 1) / following * (new - w)
        w, momentum = new, following
    model = ToxicityModel({f: float(w[i]) for f, i in place.items() if w[i]}, level=level)
    s = np.bincount(row, w[col] * val, len(y))
    model.cut = best_cut(s, y.astype(int))
    model.steep = float(2.0 / (np.abs(s - model.cut).mean() + 1e-9))
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, fold: int = 0, most: int = 4_000, id_col: str = "doc_id", text_col: str = "text", terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> ToxicityModel:
    """Fit on at most ``most`` labelled documents of each label outside the held-out fold; only their different words reach the driver."""
    ones = training_labels(labels.where(F.col(label) == 1), label, modulus, fold, most, id_col)
    zeros = training_labels(labels.where(F.col(label) == 0), label, modulus, fold, most, id_col).join(ones.select("id"), "id", "left_anti")
    sample = ones.unionByName(zeros)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [" ".join(sorted(sentence_words(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(words, pa.string())], names=["y", "words"])

    joined = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(F.broadcast(sample), "id")
    rows = joined.select("y", "text").mapInArrow(tidy(run), "y int, words string").collect()
    return fit(sorted((r["words"], r["y"]) for r in rows), terms)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``, in one map over whole texts. Null and empty texts hold no word and score as a text
    of unknown words does; other columns pass through, one named as the score is replaced."""
    kept = [c for c in docs.columns if c != score_col]
    narrow = docs.select(*[f"`{c}`" for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, text_col):
                latents = np.array([model.latent(t) for t in rows.column(text_col).to_pylist()], np.float64)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), pa.array(model.score(latents), pa.float64())], names=[*kept, score_col])

    return narrow.mapInArrow(tidy(run), f"{narrow.schema.toDDL()}, `{score_col}` double")
