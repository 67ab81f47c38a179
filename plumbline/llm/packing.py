"""Bounded-space online packing of token ids into fixed windows."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialise, slices, tidy
from plumbline.llm.memo import memo

_FIELDS = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, is_left int"
_NAMES = ["doc", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "is_left"]


class Packer:
    """At most ``windows`` open windows of ``size`` ids. A piece goes to the open window that it fits best;
    if it fits none, and all are taken, the fullest is emitted and a new one opened."""

    def __init__(self, size: int, windows: int, first_id: int):
        self.size, self.windows, self.next_id = size, windows, first_id
        self.room: list[tuple[int, int]] = []  # (ids that still fit, window), sorted
        self.held: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def _emit(self, window: int, is_left: int = 0) -> None:
        at = 0
        for doc, start, ids, total in self.held.pop(window):
            self.rows.append((doc, start, len(ids) // 4, ids, total, window, at, is_left))
            at += len(ids) // 4

    def add(self, doc, start: int, ids: bytes, total: int) -> None:
        n = len(ids) // 4
        at = bisect_left(self.room, (n, -1))
        if at < len(self.room):
            room, window = self.room.pop(at)
        else:
            if len(self.room) >= self.windows:
                self._emit(self.room.pop(0)[1])
            room, window = self.size, self.next_id
            self.next_id += 1
            self.held[window] = []
        self.held[window].append((doc, start, ids, total))
        if room > n:
            insort(self.room, (room - n, window))
        else:
            self._emit(window)

    def add_document(self, doc, ids: bytes) -> None:
        total, step = len(ids) // 4, self.size * 4
        for at in range(0, len(ids), step):
            self.add(doc, at // 4, ids[at : at + step], total)

    def close(self, is_left: int) -> None:
        for _, window in self.room:
            self._emit(window, is_left)
        self.room = []

    def taken(self, schema: pa.Schema) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = 2048, windows: int = 64, fan_in: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in windows of at most ``size`` ids: id, start in the document, length, ids (unsigned
    32-bit, little-endian), the document's ids with ``end_id``, sequence and offset there.

    Each partition tokenises and packs in one pass and holds ``windows`` open windows (``4 * size * windows``
    bytes of ids), whatever its size. Windows that are still open at its end are leftovers. They are packed
    again, ``windows * fan_in`` of them to a group, until one group holds them all, so no group grows with
    the input and the rest after the last round is at most ``windows`` windows that aren't full. A document of
    over ``size`` ids gives full pieces first; pieces aren't cut further. The first pass is written to the
    shared folder, so that a lost executor costs a re-read and sequence numbers never change.

    Null text is empty and, as every document, still has its end id. Null ids and repeated rows are packed
    like others, each row on its own; an empty table gives no pieces; other columns aren't read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    end = np.array([end_id], "<u4").tobytes()
    spec = f"doc {kind}, {_FIELDS}"

    def arrow(doc: pa.DataType) -> pa.Schema:
        return pa.schema([("doc", doc), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("is_left", pa.int32())])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, schema = memo(tokenizer), None
        packer = Packer(size, windows, TaskContext.get().partitionId() << 26)
        for batch in batches:
            schema = schema or arrow(batch.schema.field("doc").type)
            for rows in slices(batch, "text", 8 << 20):
                for doc, ids in zip(rows.column("doc").to_pylist(), held.encode_array(rows.column("text")).to_pylist(), strict=True):
                    packer.add_document(doc, ids + end)
                yield packer.taken(schema)
        packer.close(1)
        if schema:
            yield packer.taken(schema)

    def again(level: int, last: bool):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            packer = Packer(size, windows, level << 58 | key[0].as_py() << 26)
            table = table.sort_by([("length", "descending"), ("sequence_id", "ascending"), ("offset", "ascending")])
            for doc, start, ids, total in zip(*(table.column(c).to_pylist() for c in ("doc", "start", "ids", "doc_tokens")), strict=True):
                packer.add(doc, start, ids, total)
            packer.close(0 if last else 1)
            return pa.Table.from_batches([packer.taken(arrow(table.schema.field("doc").type))])

        return run

    done = []
    table = materialise(narrow.mapInArrow(tidy(first, True), spec), "packing", ["is_left"]).select(*_NAMES)
    level = 0
    while True:
        done.append(table.where("is_left = 0"))
        rest = table.where("is_left = 1")
        open_windows = rest.select("sequence_id").distinct().count()
        if not open_windows:
            break
        level += 1
        groups = max(1, open_windows // (windows * fan_in))
        dealt = rest.withColumn("bucket", F.expr(f"pmod(xxhash64(sequence_id), {groups})"))
        table = materialise(dealt.groupBy("bucket").applyInArrow(again(level, groups == 1), spec), "packing", ["is_left"]).select(*_NAMES)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("is_left").withColumnRenamed("doc", id_col)
