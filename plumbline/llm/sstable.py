"""Sorted-string-table shards of token ids.

File layout, in this order:
  blocks    each a zstd frame of about ``BLOCK`` bytes: entries in key order, then the offsets of the restart
            points (unsigned 32-bit) and their number. An entry: bytes shared with the key before it, bytes that
            aren't, bytes of the value (varints), the rest of the key, the value. Every ``RESTART``-th entry shares none.
  index     a zstd frame: for each block its last key, file offset, stored and plain size
  filter    a Bloom filter over keys: BITS bits a key, PROBES probes
  footer    FOOTER: places of index and filter, entries, ids, magic
A key is a zero byte for a null id or a one byte and the id, big-endian with the sign flipped, so that bytes sort
as ids do. A value is the document's ids, unsigned 32-bit little-endian.
"""

from __future__ import annotations

import struct
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import scratch_path, slices, tidy
from plumbline.llm.memo import memo

BLOCK, RESTART, BITS, PROBES = 1 << 18, 16, 10, 7
FOOTER = struct.Struct("<QQQQQQ8s")
MAGIC = b"PLSST\x00\x00\x01"


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else int.from_bytes(key[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    shift = n = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _mixed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of unsigned 64-bit keys."""
    out = []
    for seed in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
        z = keys + np.uint64(seed)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(z ^ (z >> np.uint64(31)))
    return out[0], out[1] | np.uint64(1)


def _hashable(key: bytes) -> int:
    return int.from_bytes(key[1:], "big") if len(key) > 1 else 0x5BD1E995


def _probes(keys: list[int], bits: int) -> np.ndarray:
    one, two = _mixed(np.array(keys, dtype=np.uint64))
    return (one[:, None] + np.arange(PROBES, dtype=np.uint64) * two[:, None]) % np.uint64(bits)


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class Writer:
    """Writes one shard; keys must come in order. The file has its name only once it is whole."""

    def __init__(self, uri: str):
        self.fs, self.path = _open(uri)
        self.partial = f"{self.path}.{uuid.uuid4().hex}.partial"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out, self.at = self.fs.open_output_stream(self.partial, compression=None), 0
        self.codec = pa.Codec("zstd", compression_level=3)
        self.index: list[tuple[bytes, int, int, int]] = []
        self.hashes: list[int] = []
        self.entries = self.ids = 0
        self._fresh()

    def _fresh(self) -> None:
        self.block, self.restarts, self.count, self.last = bytearray(), [], 0, b""

    def add(self, doc_id: int | None, ids: bytes) -> None:
        key = key_of(doc_id)
        shared = 0
        if self.count % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:] + ids
        self.last, self.count = key, self.count + 1
        self.entries, self.ids = self.entries + 1, self.ids + len(ids) // 4
        self.hashes.append(_hashable(key))
        if len(self.block) >= BLOCK:
            self._flush()

    def _put(self, raw: bytes) -> int:
        self.out.write(raw)
        self.at += len(raw)
        return len(raw)

    def _flush(self) -> None:
        if self.count:
            plain = bytes(self.block) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
            at = self.at
            self.index.append((self.last, at, self._put(self.codec.compress(plain, asbytes=True)), len(plain)))
            self._fresh()

    def close(self) -> None:
        self._flush()
        plain = b"".join(struct.pack("<BQQQ", len(k), at, stored, size) + k for k, at, stored, size in self.index)
        index_at, index_size = self.at, self._put(self.codec.compress(plain, asbytes=True))
        bits = max(64, -(-len(self.hashes) * BITS // 8) * 8)
        found = np.zeros(bits // 8, np.uint8)
        if self.hashes:
            where = _probes(self.hashes, bits).ravel()
            np.bitwise_or.at(found, (where >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (where & np.uint64(7)).astype(np.uint8)))
        filter_at, filter_size = self.at, self._put(found.tobytes())
        self._put(struct.pack("<Q", len(plain)) + FOOTER.pack(index_at, index_size, filter_at, filter_size, self.entries, self.ids, MAGIC))
        self.out.close()
        self.fs.move(self.partial, self.path)


class SSTable:
    """Reads one shard: ``scan()`` in key order, ``get(id)`` by Bloom filter and two binary searches."""

    def __init__(self, uri: str):
        self.fs, self.path = _open(uri)
        self.file = self.fs.open_input_file(self.path)
        size, tail = self.file.size(), FOOTER.size + 8
        foot = self._read(size - tail, tail)
        plain = struct.unpack_from("<Q", foot)[0]
        at, stored, self.filter_at, self.filter_size, self.entries, self.ids, magic = FOOTER.unpack_from(foot, 8)
        if magic != MAGIC:
            raise ValueError(f"{uri} isn't a table of this format")
        self.codec, self.keys, self.blocks, self.filter = pa.Codec("zstd"), [], [], None
        raw, i = self.codec.decompress(self._read(at, stored), plain, asbytes=True), 0
        while i < len(raw):
            n, *place = struct.unpack_from("<BQQQ", raw, i)
            i += 25
            self.keys.append(raw[i : i + n])
            self.blocks.append(tuple(place))
            i += n

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, i: int) -> tuple[bytes, list[int], int]:
        at, stored, size = self.blocks[i]
        raw = self.codec.decompress(self._read(at, stored), size, asbytes=True)
        n = struct.unpack_from("<I", raw, len(raw) - 4)[0]
        end = len(raw) - 4 - 4 * n
        return raw, list(struct.unpack_from(f"<{n}I", raw, end)), end

    @staticmethod
    def _entries(raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest + size
            yield key, raw[at - size : at]

    def scan(self) -> Iterator[tuple[int | None, bytes]]:
        for i in range(len(self.blocks)):
            raw, _, end = self._block(i)
            for key, value in self._entries(raw, 0, end):
                yield id_of(key), value

    def may_hold(self, doc_id: int | None) -> bool:
        if self.filter is None:
            self.filter = np.frombuffer(self._read(self.filter_at, self.filter_size), np.uint8)
        where = _probes([_hashable(key_of(doc_id))], len(self.filter) * 8).ravel().astype(np.int64)
        return bool(np.all(self.filter[where >> 3] >> (where & 7) & 1))

    def get(self, doc_id: int | None) -> list[bytes]:
        """The values of an id: none if it is absent, several if rows repeat."""
        if not self.may_hold(doc_id):
            return []
        key, found = key_of(doc_id), []
        for i in range(bisect_left(self.keys, key), len(self.blocks)):
            raw, restarts, end = self._block(i)
            at = max(0, bisect_left(restarts, key, key=lambda r: next(self._entries(raw, r, end))[0]) - 1)
            for k, value in self._entries(raw, restarts[at], end):
                if k == key:
                    found.append(value)
                if k > key:
                    return found
        return found


def write_tables(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Encode every text, append ``end_id`` and write shards in ascending id order; returns their manifest
    (path, entries, ids, first and last id; one entry per shard, in order).

    One range shuffle by id brings the rows in order; a hash of the text parts rows that share an id, and the place in the
    input those that are equal, so a repeated id or row never fills one shard. A task streams its sorted rows into blocks and keeps only the block
    index and the filter's hashes. Files get their name when whole, and only files of tasks that ended well are in
    the manifest, so a lost executor leaves nothing that is read. Null texts are empty (only the end id), null ids
    sort first, rows that share an id are ordered by text; an empty table gives no shards; ids must be integers.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "sstables")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, writer, first, last = memo(tokenizer), None, None, None
        part = TaskContext.get().partitionId()
        for batch in batches:
            for rows in slices(batch, "text", 8 << 20):
                ids = rows.column("id").to_pylist()
                if writer is None and ids:
                    uri = f"{folder}/{part:06d}-{uuid.uuid4().hex}.sst"
                    writer, first = Writer(uri), ids[0]
                for doc, raw in zip(ids, held.encode_array(rows.column("text")).to_pylist(), strict=True):
                    writer.add(doc, raw + end)
                last = ids[-1] if ids else last
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": uri, "entries": writer.entries, "ids": writer.ids, "first": first, "last": last}], schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("entries", pa.int64()), ("ids", pa.int64()), ("first", pa.int64()), ("last", pa.int64())]))

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    order = [F.asc_nulls_first("id"), F.col("hash"), F.col("text")]
    placed = narrow.withColumn("hash", F.xxhash64("text")).withColumn("place", F.spark_partition_id())
    sorted_ = placed.repartitionByRange(*order[:2], F.col("place")).sortWithinPartitions(*order).select("id", "text")
    shards = sorted_.mapInArrow(tidy(run, True), "part int, path string, entries long, ids long, first long, last long").collect()
    return [r.asDict() for r in sorted(shards, key=lambda r: r["part"])]


def read_tables(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """Every document of the shards: doc_id, start (ids before it), n_tokens, ids; a task reads a shard block by block."""
    base, shards = 0, []
    for m in manifest:
        shards.append((m["path"], base))
        base += m["ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                rows, size = [], 0
                for doc, ids in SSTable(path).scan():
                    rows.append((doc, start, len(ids) // 4, ids))
                    start, size = start + len(ids) // 4, size + len(ids)
                    if size > 4 << 20:
                        yield made(rows)
                        rows, size = [], 0
                if rows:
                    yield made(rows)

    listed = spark.createDataFrame(shards, "path string, base long")
    return listed.repartition(max(1, len(shards))).mapInArrow(tidy(run, True), "doc_id long, start long, n_tokens long, ids binary")


def lookup(manifest: list[dict], doc_id: int | None) -> list[bytes]:
    """The ids of one document, through the manifest's ranges, the filter and binary search."""
    low = lambda x: (x is not None, x or 0)
    return [v for m in manifest if low(m["first"]) <= low(doc_id) <= low(m["last"]) for v in SSTable(m["path"]).get(doc_id)]
