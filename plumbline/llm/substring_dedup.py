"""Removal of repeated passages by suffix automata of reference shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.automaton import SuffixAutomaton
from plumbline.llm.common import Scratch, free_names, slices, tidy
from plumbline.llm.near_dedup import _mix, _P, _powers_to, _signed, joined_hashes, word_starts


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but space, tab, line feed, vertical tab, form feed and carriage return."""
    return text.encode().split() if text else []


class Spans:
    """Hashes of runs of words."""

    def __init__(self, hashes: np.ndarray):
        self.up, self.down = _powers_to(len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(_mix(hashes + _P) * self.up[: len(hashes)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of the runs from one of ``starts`` to before one of ``ends``."""
        return _mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * _P)

    def grams(self, width: int) -> np.ndarray:
        """Of all runs of ``width`` words."""
        n = max(0, len(self.sums) - width)
        return _mix((self.sums[width:] - self.sums[:n]) * self.down[:n] + np.full(n, width, np.uint64) * _P)


_PLACE = np.uint64((1 << 20) - 1)


def _least(grams: np.ndarray, inner: int) -> np.ndarray:
    """For each run of ``inner`` grams, where the first least one stands, by their upper 44 bits."""
    out, step = [], 1 << 19
    for low in range(0, max(1, len(grams) - inner + 1), step):
        some = grams[low : low + step + inner - 1]
        best, width = some & ~_PLACE | np.arange(len(some), dtype=np.uint64), 1
        while 2 * width <= inner:
            best, width = np.minimum(best[:-width], best[width:]), 2 * width
        if inner > width:
            best = np.minimum(best[: width - inner], best[inner - width :])
        out.append((best & _PLACE).astype(np.int64) + low)
    return np.concatenate(out)


def anchors(hashes: np.ndarray, bounds: np.ndarray, window: int, gram: int, spans: Spans | None = None) -> tuple[np.ndarray, ...]:
    """(text, hash, position, first window, windows) of the anchors of texts whose words lie between ``bounds``: the first
    least ``gram``-word run of every window. Which run of a window it is depends on the window's words alone, so equal
    windows have equal anchors at equal places. The windows of an anchor follow each other. Places are of all words."""
    none = np.zeros(0, np.int64)
    if len(hashes) < window:
        return none, none.astype(np.uint64), none, none, none
    grams = (spans or Spans(hashes)).grams(gram)
    at = _least(grams, window - gram + 1)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    whole = np.flatnonzero(np.arange(len(at)) + window <= bounds[1:][text[: len(at)]])
    at = at[whole]
    new = np.flatnonzero(np.diff(at, prepend=-1))
    return text[at[new]], grams[at[new]], at[new], whole[new], np.diff(np.append(new, len(at)))


def repeated_windows(texts: DataFrame, scratch: Scratch, window: int = 35, gram: int = 16, shard_words: int = 100_000, most_pieces: int = 2_000, most_sent: int = 1 << 16, often: int = 16) -> DataFrame:
    """``key`` and ``windows``, pairs of a window's start and the bits of the windows from there on, of the texts (``key``,
    ``text``) that hold windows which also start elsewhere.

    1. Anchors. From each text a winnowed tenth of its ``gram``-word runs; their counts over the corpus tell which texts
       and places can repeat at all. Equal texts are one row with a multiplicity from here on.
    2. Pieces. The windows of one anchor follow each other; their words are a piece. Equal pieces are counted by hash,
       partial counts first, and one of them stands for all. An anchor with one piece that stands twice repeats whole.
    3. Reference shards. The different pieces of the other anchors are dealt by anchor, so that a shard holds all that can
       repeat a window of its own; pieces of up to ``shard_words`` words make a suffix automaton, whose states know how
       often their words stand in the corpus. The pieces are streamed against it for matching statistics: runs of
       ``window`` words or more that stand there twice. An automaton that travelled to all documents would meet every
       document of the corpus; this one meets just those pieces of documents that share an anchor with it.
    4. Anchors with more than ``most_pieces`` different pieces, the edges of very common passages, would make an automaton
       without bound. Their windows are counted by hash, partial counts first, which splits them over all tasks.
    5. The decisions go back to the texts. The ``most_sent`` pieces that stand most often, ``often`` times at least, are sent to
       all tasks (24 bytes each) and found again in the texts, so that no row arises for each of their places; the
       others are joined.
    """
    gram = min(gram, window)
    gram = max(gram, window - 61)  # the windows of an anchor are bits of a long

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                hashes, bounds = joined_hashes(part.column("text").cast(pa.binary()).to_pylist())
                text, hash_, place, _, _ = anchors(hashes, bounds, window, gram)
                kept, n = np.unique(text, return_counts=True)
                ends = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(_signed(hash_)), pa.array((place - bounds[text]).astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(kept)), *lists], names=["key", "hashes", "positions"])

    found = texts.mapInArrow(tidy(find), "key binary, hashes array<long>, positions array<int>")
    own = found.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.first("hashes").alias("hashes"), F.first("positions").alias("positions"))
    own = scratch.keep(own.withColumn("node", F.monotonically_increasing_id()), "anchors")
    each = own.select("node", "copies", F.explode(F.arrays_zip("hashes", "positions")).alias("x")).select("node", "copies", F.col("x.hashes").alias("hash"), F.col("x.positions").alias("position"))
    live = each.groupBy("hash").agg(F.sum("copies").alias("n")).where("n > 1").select("hash")
    hits = scratch.keep(each.select("node", "hash", "position").join(live, "hash").groupBy("node").agg(F.collect_list("position").alias("positions")), "live")
    wanted = hits.join(own.select("node", "key", "copies"), "node")
    chosen = scratch.keep(wanted.join(texts.dropDuplicates(["key"]), "key"), "candidates")
    scratch.drop("anchors", "live")

    def pieces_of(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """(text, anchor's hash, piece's hash, first window, windows) of the pieces of live anchors."""
        hashes, bounds = joined_hashes(part.column("text").cast(pa.binary()).to_pylist())
        spans = Spans(hashes)
        text, hash_, place, first, n = anchors(hashes, bounds, window, gram, spans)
        lists = part.column("positions")
        alive = lists.flatten().to_numpy() + bounds[np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())]
        live = np.isin(place, alive)
        text, first, n = text[live], first[live], n[live]
        return text, _signed(hash_[live]), _signed(spans(first, first + n - 1 + window)), (first - bounds[text]).astype(np.int32), n.astype(np.int32)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                text, hash_, piece, first, n = pieces_of(part)
                cols = [hash_, piece, part.column("node").to_numpy()[text], first, n, part.column("copies").to_numpy()[text]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["hash", "piece", "node", "first", "n", "copies"])

    standing = scratch.keep(chosen.mapInArrow(tidy(pieces), "hash long, piece long, node long, first int, n int, copies long"), "pieces")
    different = scratch.keep(standing.groupBy("hash", "piece").agg(F.sum("copies").alias("copies"), F.min(F.struct("node", "first", "n")).alias("at")), "different")
    anchor = different.groupBy("hash").agg(F.count(F.lit(1)).alias("pieces"), F.sum("copies").alias("all")).where("all > 1")
    asked = scratch.keep(different.join(anchor.select("hash", "pieces"), "hash").select("hash", "piece", "copies", "pieces", "at.*"), "asked")
    scratch.drop("different")
    alone = asked.where("pieces = 1").select("hash", "piece", "copies", F.expr("shiftleft(1L, n) - 1").alias("bits"))
    at = F.collect_list(F.struct("hash", "piece", "copies", "pieces", "first", "n")).alias("at")
    cuttable = scratch.keep(asked.where("pieces > 1").groupBy("node").agg(at).join(chosen.select("node", "text"), "node").select("text", "at"), "cuttable")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words of the pieces that automata are made of."""
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                rows = []
                for text, places in zip(part.column("text").to_pylist(), part.column("at").to_pylist(), strict=True):
                    words = words_of(text)
                    rows += [(x["hash"], x["piece"], x["copies"], b" ".join(words[x["first"] : x["first"] + x["n"] - 1 + window]).decode()) for x in places if x["pieces"] <= most_pieces]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["hash", "piece", "copies", "words"])

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Build an automaton of the pieces of some anchors and stream them against it."""

        def told(held: list[tuple[int, int, int, str]]) -> pa.RecordBatch:
            automaton = SuffixAutomaton()
            coded = [automaton.add(words.encode().split(), copies) for _, _, copies, words in held]
            automaton.count()
            bits = [sum(1 << i for i in automaton.repeats(c, window)) for c in coded]
            return pa.RecordBatch.from_arrays([*(pa.array([h[i] for h in held], pa.int64()) for i in range(3)), pa.array(bits, pa.int64())], names=["hash", "piece", "copies", "bits"])

        held: list[tuple[int, int, int, str]] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("hash", "piece", "copies", "words")), strict=True):
                if size >= shard_words and row[0] != held[-1][0]:
                    yield told(held)
                    held, size = [], 0
                held.append(row)
                size += row[3].count(" ") + 1
        if held:
            yield told(held)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows of the pieces of the anchors that have very many."""
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                cols: list[list] = [[], [], [], [], []]
                for text, places in zip(part.column("text").to_pylist(), part.column("at").to_pylist(), strict=True):
                    places = [x for x in places if x["pieces"] > most_pieces]
                    spans = Spans(joined_hashes([text.encode()])[0]) if places else None
                    for x in places:
                        starts = np.arange(x["first"], x["first"] + x["n"])
                        for c, y in zip(cols, (np.full(x["n"], x["hash"]), np.full(x["n"], x["piece"]), _signed(spans(starts, starts + window)), np.int64(1) << np.arange(x["n"]), np.full(x["n"], x["copies"])), strict=True):
                            c.append(y)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["hash", "piece", "window", "bit", "copies"])

    dealt = cuttable.mapInArrow(tidy(cut), "hash long, piece long, copies long, words string").repartition("hash").sortWithinPartitions("hash")
    told = dealt.mapInArrow(tidy(matched), "hash long, piece long, copies long, bits long")
    common = cuttable.mapInArrow(tidy(windows), "hash long, piece long, window long, bit long, copies long")
    twice = common.groupBy("hash", "window").agg(F.sum("copies").alias("all")).where("all > 1").select("hash", "window")
    counted = common.join(twice, ["hash", "window"]).groupBy("hash", "piece").agg(F.first("copies").alias("copies"), F.bit_or("bit").alias("bits"))
    decided = scratch.keep(alone.unionByName(told).unionByName(counted).where("bits != 0"), "decided")
    scratch.drop("asked", "cuttable")
    top = decided.where(F.col("copies") >= often).orderBy(F.desc("copies")).limit(most_sent + 1).collect()
    least = top[-1]["copies"] if len(top) > most_sent else often - 1  # pieces that stand as often as the one too many are joined
    top = np.array([(r["hash"], r["piece"], r["bits"]) for r in top if r["copies"] > least], np.int64).reshape(-1, 3)
    sent = scratch.spark.sparkContext.broadcast(top[np.lexsort((top[:, 1], top[:, 0]))])

    def found_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows of the pieces that were sent, of each text that holds some."""
        known = sent.value
        kind = pa.struct([("first", pa.int32()), ("bits", pa.int64())])
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                text, hash_, piece, first, _ = pieces_of(part)
                at, end = known[:, 0].searchsorted(hash_), known[:, 0].searchsorted(hash_, side="right")
                bits = np.zeros(len(text), np.int64)
                while (at < end).any():  # an anchor may have several pieces
                    open_ = np.flatnonzero(at < end)
                    same = known[at[open_], 1] == piece[open_]
                    bits[open_[same]] = known[at[open_[same]], 2]
                    at[open_] += 1
                held = np.flatnonzero(bits)
                kept, n = np.unique(text[held], return_counts=True)
                pairs = pa.StructArray.from_arrays([pa.array(first[held]), pa.array(bits[held])], fields=list(kind))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pairs)
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(kept)), lists], names=["key", "windows"])

    joined = standing.select("hash", "piece", "node", "first").join(decided.where(F.col("copies") <= least), ["hash", "piece"])
    back = joined.groupBy("node").agg(F.collect_list(F.struct("first", "bits")).alias("windows")).join(chosen.select("node", "key"), "node").select("key", "windows")
    again = chosen.mapInArrow(tidy(found_again), "key binary, windows array<struct<first: int, bits: bigint>>")
    out = scratch.keep(back.unionByName(again).groupBy("key").agg(F.flatten(F.collect_list("windows")).alias("windows")), "windows")
    scratch.drop("candidates", "pieces", "decided")
    return out


def remove_repeats(docs: DataFrame, window: int = 35, text_col: str = "text", removed_col: str = "n_removed", words_col: str = "n_words") -> DataFrame:
    """``docs`` without the words of any window of ``window`` words whose word sequence also starts elsewhere in the
    corpus (the same document included), judged on the input. ``words_col`` has the words before, ``removed_col`` those
    removed; a text that lost words is its kept words joined by one space, others stay as they are.

    Null and empty texts have no words and stay. Equal texts of ``window`` words or more lose all words, as each repeats
    the other. Repeated and null ids don't matter (no id is used); an empty table gives no rows; other columns pass
    through, whatever their names; those named as the two counts are replaced.
    """
    scratch = Scratch(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (removed_col, words_col)]
    key_col, found_col = free_names(docs, "key", "windows")
    keyed = docs.select(*[F.col(f"`{c}`") for c in kept], F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"))).alias(key_col))
    texts = keyed.select(F.col(key_col).alias("key"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    found = repeated_windows(texts, scratch, window).withColumnsRenamed({"key": key_col, "windows": found_col})
    joined = keyed.join(found, key_col, "left").drop(key_col)

    def left_of(text: str, found: list[dict]) -> tuple[str, int]:
        """The words of a text that no repeated window covers, and how many are covered."""
        words = words_of(text)
        cover = np.zeros(len(words) + 1, np.int64)
        for x in found:
            own, bits = [], x["bits"]
            while bits:
                low = bits & -bits
                own.append(x["first"] + low.bit_length() - 1)
                bits ^= low
            cover[own] += 1
            cover[[i + window for i in own]] -= 1
        left = [w for w, n in zip(words, np.cumsum(cover[:-1]).tolist(), strict=True) if not n]
        return b" ".join(left).decode(), len(words) - len(left)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                texts = part.column(text_col).cast(pa.string())
                raws = pc.fill_null(texts.cast(pa.binary()), b"").to_pylist()
                ends = np.cumsum([0] + [len(r) + 1 for r in raws])
                n_words = np.diff(np.searchsorted(word_starts(b" ".join(raws) + b" "), ends))
                n_removed = np.zeros(len(raws), np.int64)
                touched = np.flatnonzero(part.column(found_col).is_valid().to_numpy(zero_copy_only=False))
                if len(touched):
                    made = [left_of(raws[i].decode(), part.column(found_col)[i].as_py()) for i in touched.tolist()]
                    n_removed[touched] = [n for _, n in made]
                    mask = np.zeros(len(raws), bool)
                    mask[touched] = True
                    texts = pc.replace_with_mask(texts, pa.array(mask), pa.array([t for t, _ in made], pa.string()))
                columns = [texts if c == text_col else part.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(n_removed)], names=[*kept, words_col, removed_col])

    ddl = docs.select(*[f"`{c}`" for c in kept]).schema.toDDL()
    return joined.mapInArrow(tidy(run), f"{ddl}, `{words_col}` long, `{removed_col}` long")


def plain_words():
    """The text's words joined by one space, for a text of any white space; null is empty."""
    squeezed = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return F.trim(squeezed)
