"""Token counts of whole texts, huge ones by overlap resynchronisation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import slices, tidy
from plumbline.llm.memo import memo


def _boundaries(encoding) -> tuple[np.ndarray, np.ndarray]:
    """Where each pre-token of an encoding starts: character offset, and the tokens before it."""
    words = np.array([-1 if w is None else w for w in encoding.word_ids], dtype=np.int64)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    heads = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
    offsets = encoding.offsets
    starts = np.array([offsets[i][0] for i in heads], dtype=np.int64)
    return starts, heads


def resync_ids(encode: Callable, text: str, chunk_chars: int = 32_768, overlap_chars: int = 512, margin: int = 16) -> tuple[np.ndarray, int, int]:
    """Ids of ``text`` from overlapping chunks, with the number of chunks and of widened overlaps.

    Each chunk is encoded with offsets. The pattern that cuts pre-tokens runs from left to right and looks
    ahead two characters at most (special strings: ``margin``), so every pre-token of the chunk so far that ends
    ``margin`` characters before the chunk's end is one of the whole text: its boundary is proven. The next
    chunk starts ``overlap_chars`` earlier, at a place that may not be a boundary. Where it has a pre-token
    boundary at a proven one, both continue alike from there, and the ids are spliced. Without a common
    boundary in the overlap, it is doubled (up to the last proven splice) and the next chunk encoded anew. An overlap
    reaches back beyond the chunk's last proven boundary at least. A chunk without any is encoded anew at twice
    its length, so text without boundaries costs in proportion to its length, too.
    """
    n = len(text)
    out: list[np.ndarray] = []
    begin, chunks, widened = 0, 0, 0  # begin: a proven boundary; everything before it is in out
    end = min(n, chunk_chars)
    encoding = encode(text[begin:end])
    chunks += 1
    while end < n:
        ids = np.array(encoding.ids, dtype="<u4")
        starts, heads = _boundaries(encoding)
        starts = starts + begin
        proven = {int(s): int(h) for s, h in zip(starts, heads, strict=True) if begin < s <= end - margin}
        if not proven:
            end, widened = min(n, end + max(chunk_chars, end - begin)), widened + 1
            encoding = encode(text[begin:end])
            chunks += 1
            continue
        width = overlap_chars
        if end - width >= (last := max(proven)):
            width, widened = end - last + overlap_chars, widened + 1
        while True:
            at = max(begin, end - width)
            stop = min(n, end + chunk_chars)
            following = encode(text[at:stop])
            chunks += 1
            # chunk of its own start: the first pre-token may be a fragment, so a boundary at `at` itself proves nothing unless at == begin
            theirs, their_heads = _boundaries(following)
            theirs = theirs + at
            common = [(int(s), int(h)) for s, h in zip(theirs, their_heads, strict=True) if int(s) in proven and (s > at)]
            if common:
                s, h = common[-1]
                out.append(ids[: proven[s]])
                # keep only what follows the splice; `begin` moves to it
                encoding, begin, end = _Tail(following, h, s - at), s, stop
                break
            width, widened = width * 2, widened + 1
    out.append(np.array(encoding.ids, dtype="<u4"))
    return np.concatenate(out), chunks, widened


class _Tail:
    """An encoding from one of its boundaries on, offsets counted from there."""

    def __init__(self, encoding, head: int, chars: int):
        self.ids = encoding.ids[head:]
        self.word_ids = encoding.word_ids[head:]
        self.offsets = [(a - chars, b - chars) for a, b in encoding.offsets[head:]]


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, chunk_chars: int = 32_768, overlap_chars: int = 512) -> DataFrame:
    """One row per row of ``docs``: its id, UTF-8 bytes, tokens, and whether they exceed ``limit``.

    Texts of up to ``chunk_chars`` characters are encoded whole (through a word memo), longer ones in chunks
    that are spliced (``n_chunks`` > 1, ``n_widened`` overlaps that had to grow). No row meets another, so
    the work is one map over the scan without a shuffle, and a task holds a few MB of text at a time.

    Null text counts as empty (0 bytes, 0 tokens); null ids, repeated rows and an empty table pass through;
    columns beside the two that are named are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = memo(tokenizer)
        if held.tokenizer.encode("a b", add_special_tokens=False).offsets[-1][0] != 1:
            raise ValueError("a file whose offsets leave spaces out, or which drops them, gives no boundaries to splice at")
        for batch in batches:
            for rows in slices(batch, "text", 8 << 20):
                texts = pc.fill_null(rows.column("text"), "")
                short = pc.less_equal(pc.utf8_length(texts), chunk_chars)
                tokens = pc.binary_length(held.encode_array(pc.if_else(short, texts, ""))).to_numpy().astype(np.int64) // 4
                chunks, widened = np.ones(len(tokens), np.int32), np.zeros(len(tokens), np.int32)
                for i in np.flatnonzero(~short.to_numpy(zero_copy_only=False)).tolist():
                    ids, chunks[i], widened[i] = resync_ids(lambda s: held.tokenizer.encode(s, add_special_tokens=False), texts[i].as_py(), chunk_chars, overlap_chars)
                    tokens[i] = len(ids)
                size = pc.binary_length(texts).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column("id"), size, pa.array(tokens), pa.array(tokens > limit), pa.array(chunks), pa.array(widened)], names=[id_col, "n_bytes", "n_tokens", "over_limit", "n_chunks", "n_widened"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return narrow.mapInArrow(tidy(run, True), f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean, n_chunks int, n_widened int")
