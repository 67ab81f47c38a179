"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by documents: a row is a segment, the postings of a run of whole documents. It lists the
segment's documents with the position at which each starts, its terms, and for each term its positions, ascending.
Segments are searched on their own, so neither building nor searching shuffles a posting, and a frequent term is
spread over all segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialise, slices, tidy

#: Bytes of a text to word bytes: A-Z to lower case, what isn't of a word to a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_INDEX = "docs array<{kind}>, tags array<long>, starts binary, terms array<binary>, list_starts binary, steps binary"


def words(text: str | None) -> list[bytes]:
    """The words of a text: A-Z lower-cased, then runs of ASCII letters, digits and anything past ASCII."""
    return text.encode().translate(_TABLE).split() if text else []


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = 4 << 20) -> DataFrame:
    """The positional index of all documents, written to the shared folder.

    A segment holds documents of about ``segment_bytes`` of text, one at least. ``tags`` are hashes of the texts, to
    join results back where ids repeat. Null and empty texts are documents without positions.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("tag"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text", segment_bytes):
                known: dict[bytes, int] = {}
                found, starts = [], [0]
                for text in rows.column("text").to_pylist():
                    own = [known.setdefault(w, len(known)) for w in words(text)]
                    found.append(np.array(own, np.int32))
                    starts.append(starts[-1] + len(own))
                ids = np.concatenate(found) if found else np.zeros(0, np.int32)
                order = np.argsort(ids, kind="stable").astype(np.int32)
                lists = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=len(known)))]).astype(np.int32)
                steps = np.diff(order, prepend=np.int32(0))
                heads = lists[:-1]
                steps[heads] = order[heads]  # each list starts afresh
                doc = rows.column("id")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc.to_pylist()], pa.list_(doc.type)), pa.array([rows.column("tag").to_pylist()], pa.list_(pa.int64())), pa.array([np.array(starts, np.int32).tobytes()], pa.binary()), pa.array([list(known)], pa.list_(pa.binary())), pa.array([lists.tobytes()], pa.binary()), pa.array([steps.astype(np.int32).tobytes()], pa.binary())],
                    names=["docs", "tags", "starts", "terms", "list_starts", "steps"],
                )

    return materialise(narrow.mapInArrow(tidy(run), _INDEX.format(kind=kind)), "positional-index")


class Segment:
    """One row of the index in memory, cut to the terms that a search asks for."""

    def __init__(self, row: dict, wanted: dict[bytes, int]):
        self.docs, self.tags = row["docs"], row["tags"]
        self.starts = np.frombuffer(row["starts"], np.int32).astype(np.int64)
        self.size = int(self.starts[-1])
        lists, steps = np.frombuffer(row["list_starts"], np.int32), np.frombuffer(row["steps"], np.int32)
        place = [(wanted[t], i) for i, t in enumerate(row["terms"]) if t in wanted]
        place.sort()
        self.counts, self.at = np.zeros(len(wanted) + 1, np.int64), np.zeros(len(wanted) + 1, np.int64)
        keys, at = [], 0
        for term, i in place:
            own = np.cumsum(steps[lists[i] : lists[i + 1]], dtype=np.int64)
            self.counts[term], self.at[term] = len(own), at
            keys.append(own + term * (self.size + 1))
            at += len(own)
        #: term and position in one number, ascending: the lists of all wanted terms one after another
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)

    def holds(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Whether each position is in the list of its term."""
        key = terms * (self.size + 1) + positions
        at = np.searchsorted(self.keys, key)
        inside = (positions >= 0) & (positions < self.size) & (at < len(self.keys))
        inside[inside] = self.keys[at[inside]] == key[inside]
        return inside

    def candidates(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All positions of each term: (which of the terms, position)."""
        counts = self.counts[terms]
        which = np.repeat(np.arange(len(terms)), counts)
        place = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + self.at[terms][which]
        return which, self.keys[place] - terms[which] * (self.size + 1)

    def phrases(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact occurrences of equally long windows of terms: (window, position). Each starts from the list of its
        rarest term here, moved by that term's offset, and is intersected with the others' lists, rarest first."""
        none = np.zeros(0, np.int64)
        counts = self.counts[windows]
        alive = np.flatnonzero(counts.min(axis=1) > 0)
        if not len(alive):
            return none, none
        order = np.argsort(counts[alive], axis=1, kind="stable")
        kept, length = windows[alive], windows.shape[1]
        rows = np.arange(len(alive))
        which, at = self.candidates(kept[rows, order[:, 0]])
        at = at - order[which, 0]
        for j in range(1, length):
            offset = order[which, j]
            good = self.holds(kept[which, offset], at + offset)
            which, at = which[good], at[good]
        doc = np.searchsorted(self.starts, at, side="right") - 1
        good = at + length <= self.starts[doc + 1] if len(at) else np.zeros(0, bool)
        return alive[which[good]], at[good]

    def near(self, terms: list[int], slop: int) -> np.ndarray:
        """Positions of the rarest of ``terms`` with every other one at most ``slop`` words away in the same document."""
        terms = sorted(set(terms), key=lambda t: self.counts[t])
        if not terms or not self.counts[terms[0]]:
            return np.zeros(0, np.int64)
        _, at = self.candidates(np.array(terms[:1]))
        for term in terms[1:]:
            doc = np.searchsorted(self.starts, at, side="right") - 1
            low, high = np.maximum(at - slop, self.starts[doc]), np.minimum(at + slop, self.starts[doc + 1] - 1)
            base = term * (self.size + 1)
            at = at[np.searchsorted(self.keys, base + low) < np.searchsorted(self.keys, base + high, side="right")]
        return at


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The test items with words, in blocks of about ``block_words`` words; one block is on the driver at a time."""
    block, held = [], 0
    for item, text in benchmark.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")).toLocalIterator():
        own = words(text)
        if own:
            block.append((item, own))
            held += len(own)
        if held >= block_words:
            yield block
            block, held = [], 0
    if block:
        yield block


def _search(block: list[tuple[str, list[bytes]]], window: int):
    """The map over index rows that finds the windows of one block of items."""
    terms: dict[bytes, int] = {}
    coded = [(item, [terms.setdefault(w, len(terms)) for w in own]) for item, own in block]
    by_length: dict[int, dict[tuple, list]] = {}
    for item, own in coded:
        length = min(window, len(own))
        for i in range(len(own) - length + 1):
            by_length.setdefault(length, {}).setdefault(tuple(own[i : i + length]), []).append(item)
    # windows by the term that is likely to be their rarest: the one that the items use least, or the longest
    spelled, used = list(terms), np.bincount(np.concatenate([np.array(own) for _, own in coded]) if coded else np.zeros(0, int), minlength=len(terms))
    rank = np.empty(len(terms), np.int64)
    rank[np.lexsort((np.array([-len(t) for t in spelled], int), used))] = np.arange(len(terms))
    sets = []
    for n, found in by_length.items():
        windows, items = np.array(list(found), np.int64), list(found.values())
        key = windows[np.arange(len(windows)), rank[windows].argmin(axis=1)]
        order = np.argsort(key, kind="stable")
        sets.append((n, windows[order], [items[i] for i in order], key[order]))

    def run(batches: Iterator[pa.RecordBatch], plan: tuple) -> Iterator[pa.RecordBatch]:
        terms, sets = plan
        for batch in batches:
            for i in range(batch.num_rows):
                seg = Segment(batch.slice(i, 1).to_pylist()[0], terms)
                cover, pairs = np.zeros(seg.size + 1, np.int64), set()
                present = np.flatnonzero(seg.counts)
                for length, windows, items, key in sets:
                    # only windows whose likely rarest term is here
                    low, high = np.searchsorted(key, present), np.searchsorted(key, present, side="right")
                    some = np.repeat(low - np.append(0, np.cumsum(high - low)[:-1]), high - low) + np.arange((high - low).sum())
                    if not len(some):
                        continue
                    which, at = seg.phrases(windows[some])
                    which = some[which]
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + length, -1)
                    doc = np.searchsorted(seg.starts, at, side="right") - 1
                    for w, d in set(zip(which.tolist(), doc.tolist(), strict=True)):
                        pairs.update((d, item) for item in items[w])
                hit = np.cumsum(cover[:-1]) > 0
                by_doc: dict[int, list] = {}
                for d, item in pairs:
                    by_doc.setdefault(d, []).append(item)
                lengths = np.diff(seg.starts)
                spans = [[] for _ in seg.docs]
                for d in by_doc:
                    own = np.flatnonzero(np.diff(np.concatenate([[0], hit[seg.starts[d] : seg.starts[d + 1]].astype(np.int8), [0]])))
                    spans[d] = [{"start": int(a), "end": int(b)} for a, b in own.reshape(-1, 2)]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                doc_kind = batch.schema.field("docs").type.value_type
                yield pa.RecordBatch.from_arrays([pa.array(seg.docs, doc_kind), pa.array(seg.tags, pa.int64()), pa.array(lengths, pa.int64()), pa.array(spans, kind), pa.array([sorted(by_doc.get(d, []), key=lambda x: (x is None, x or "")) for d in range(len(seg.docs))], pa.list_(pa.string()))], names=["doc", "tag", "n_words", "spans", "items"])

    return run, (terms, sets)


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_words: int = 1 << 20) -> DataFrame:
    """One row per document: id, tag (hash of the text), n_words, the merged word spans that occurrences of test
    windows cover, and the ids (as strings, sorted) of the items with an occurring window.

    A window is ``window`` consecutive words of an item; an item with fewer words is one window. The items are
    searched in blocks of ``block_words`` words, each block in one pass over the index, so that what goes to a task
    is bounded however large the test sets are; with several blocks, a document's spans are merged afterwards.

    Null or empty texts have no words; null and repeated ids are rows of their own; items that repeat count once by id;
    items without id are one item, null, which stands last; without items no word is hit; an empty corpus gives no rows; other columns aren't read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    index = build_index(docs, id_col, text_col)
    fields = f"doc {kind}, tag long, n_words long, spans array<struct<start: bigint, end: bigint>>, items array<string>"
    spark, parts = docs.sparkSession, []
    for block in _blocks(benchmark, item_id_col, item_text_col, block_words):
        parts.append(_pass(spark, index, block, window, fields))
    if not parts:
        parts.append(_pass(spark, index, [], window, fields))
    if len(parts) == 1:
        return parts[0].withColumnRenamed("doc", id_col)
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)

    def merged(spans: pd.Series) -> pd.Series:
        def one(found) -> list[dict]:
            out: list[dict] = []
            for s in sorted(({"start": int(x["start"]), "end": int(x["end"])} for x in found), key=lambda x: x["start"]):
                if out and s["start"] <= out[-1]["end"]:
                    out[-1]["end"] = max(out[-1]["end"], s["end"])
                else:
                    out.append(s)
            return out

        return spans.map(one)

    merge = F.pandas_udf(merged, "array<struct<start: bigint, end: bigint>>")
    # rows alike in id and text are alike in every block: the number of blocks tells how many of them there are
    grouped = every.groupBy("doc", "tag", "n_words").agg((F.count(F.lit(1)) / len(parts)).cast("int").alias("copies"), F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return grouped.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(F.col("doc").alias(id_col), "tag", "n_words", merge("spans").alias("spans"), "items")


def _pass(spark, index: DataFrame, block: list, window: int, fields: str) -> DataFrame:
    run, plan = _search(block, window)
    shared = spark.sparkContext.broadcast(plan)
    return index.mapInArrow(tidy(lambda batches: run(batches, shared.value)), fields)


def proximity(index: DataFrame, phrase: str, slop: int) -> DataFrame:
    """Documents in which all words of ``phrase`` stand within ``slop`` words of its rarest one there: id, position of that word."""
    wanted = {w: i for i, w in enumerate(dict.fromkeys(words(phrase)))}
    kind = index.schema["docs"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                seg = Segment(batch.slice(i, 1).to_pylist()[0], wanted)
                at = seg.near(list(wanted.values()), slop)
                doc = np.searchsorted(seg.starts, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array([seg.docs[d] for d in doc], batch.schema.field("docs").type.value_type), pa.array(at - seg.starts[doc], pa.int64())], names=["doc", "position"])

    return index.mapInArrow(tidy(run), f"doc {kind}, position long")


def n_hit() -> Column:
    """Words under the spans."""
    return F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")
