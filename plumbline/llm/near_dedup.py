"""Near-duplicate classes by MinHash with tensored banding and exact confirmation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialise, meet, release, slices, tidy
from plumbline.llm.components import components

#: Bytes of a text to word bytes: A-Z to lower case, white space (tab to carriage return, space) to a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 32 or 9 <= b <= 13 else b for b in range(256))
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_BYTES = np.random.default_rng(20).integers(0, 1 << 63, 256, np.uint64)
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    if len(_powers[0]) < n:
        odd, n = int(_P), 1 << (n - 1).bit_length()
        for i, base in enumerate((odd, pow(odd, -1, 1 << 64))):
            _powers[i] = np.multiply.accumulate(np.append(np.uint64(1), np.full(n - 1, base, np.uint64)))
    return _powers


def _hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of ``raw``, which ends with white space."""
    b = np.frombuffer(raw, np.uint8)
    edge = np.diff(_SPACE[b].astype(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers_to(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTES[b] * up[: len(b)], out=sums[1:])
    h = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _P)
    for i in np.flatnonzero(ends - starts > 512):
        h[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]])
    return starts, h


def word_starts(raw: bytes) -> np.ndarray:
    """Where the words of ``raw`` start."""
    space = _SPACE[np.frombuffer(raw, np.uint8)]
    return np.flatnonzero(~space & np.append(True, space[:-1])) if len(raw) else np.zeros(0, np.int64)


def joined_hashes(texts: list[bytes], block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, parted at ASCII white space, and where each text's begin and the last's end.

    All bytes of some ``block`` at once, up to a space: a word's hash is the difference of two prefix sums of byte values
    times powers, shifted to the word's start. Words of over 512 bytes, for which such sums can be made to meet, are
    hashed singly.
    """
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    raw = b" ".join(texts) + b" "
    found, at = [], 0
    while at < len(raw):
        end = raw.rfind(b" ", at, at + block) + 1 or raw.find(b" ", at + block) + 1
        starts, h = _hashes(raw[at:end])
        found.append((starts + at, h))
        at = end
    bounds = np.searchsorted(np.concatenate([s for s, _ in found]), np.cumsum([0] + [len(t) + 1 for t in texts]))
    return np.concatenate([h for _, h in found]), bounds


def word_hashes(texts: list[bytes], block: int = 1 << 18) -> list[np.ndarray]:
    """``joined_hashes``, for each text."""
    hashes, bounds = joined_hashes(texts, block)
    return np.split(hashes, bounds[1:-1]) if texts else []


def shingles(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of whole texts; fewer words are one shingle."""
    out = []
    for h in word_hashes([(t or "").encode().translate(_TABLE) for t in texts]):
        if not len(h):
            out.append(np.zeros(0, np.uint64))
            continue
        n = max(1, len(h) - width + 1)
        made = np.full(n, np.uint64(min(len(h), width)))
        for i in range(min(width, len(h))):
            made = _mix(made * _P + h[i : i + n])
        out.append(np.unique(made))
    return out


def half_bands(sets: list[np.ndarray], halves: int, rows: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Two collections of ``halves`` half-bands for each set that isn't empty: a key mixes ``rows`` minhashes.
    Column i < halves is half-band i of the first collection, the others are of the second. And the set's sketch, a byte of
    each minhash."""
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 1 << 63, (2 * halves, rows), np.uint64) * np.uint64(2) + np.uint64(1)
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out, sketch = np.empty((len(sets), 2 * halves), np.uint64), np.empty((len(sets), 2 * halves * rows), np.uint8)
    for i in range(2 * halves):
        key = np.full(len(sets), np.uint64(i + 1))
        for r in range(rows):
            least = np.minimum.reduceat(flat * odd[i, r], starts)
            sketch[:, i * rows + r] = _mix(least) >> np.uint64(56)
            key = _mix(key * _P + least)
        out[:, i] = key
    return out, sketch


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _measures(sets: list[np.ndarray], halves: int, rows: int) -> tuple[list[pa.Array], list[str]]:
    """Shingles, a 128-bit digest, the half-band keys and the sketch of each set."""
    filled = [s for s in sets if len(s)]
    keys, sketch = half_bands(filled, halves, rows) if filled else (np.zeros((0, 0), np.uint64), [])
    keys, sketch = iter(_signed(keys).tolist()), iter([s.tobytes() for s in sketch])
    digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
    return [pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())), pa.array([next(sketch) if len(s) else None for s in sets], pa.binary())], ["n_shingles", "digest", "keys", "sketch"]


def measure(docs: DataFrame, width: int, halves: int, rows: int) -> DataFrame:
    """Id, tag and the measures of the shingles of each row, in one map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                made, names = _measures(shingles(part.column("text").to_pylist(), width), halves, rows)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("tag"), *made], names=["id", "tag", *names])

    return docs.mapInArrow(tidy(run), "id long, tag binary, n_shingles long, digest binary, keys array<long>, sketch binary")


def unite(docs: DataFrame, width: int) -> DataFrame:
    """The distinct shingles of all texts of each id."""
    each = shingle_sets(docs, width).select("id", F.explode("shingles").alias("shingle")).distinct()
    return each.groupBy("id").agg(F.collect_list("shingle").alias("shingles"))


def measure_united(united: DataFrame, halves: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made, names = _measures([np.sort(np.array(s, np.int64).view(np.uint64)) for s in part.column("shingles").to_pylist()], halves, rows)
                yield pa.RecordBatch.from_arrays([part.column("id"), *made], names=["id", *names])

    return united.mapInArrow(tidy(run), "id long, n_shingles long, digest binary, keys array<long>, sketch binary")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                sets = [_signed(s) for s in shingles(part.column("text").to_pylist(), width)]
                ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists], names=["id", "shingles"])

    return docs.mapInArrow(tidy(run), "id long, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a``, ``b`` with the sizes of intersection and union of their full sets."""
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b"))
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a"))
    joined = meet(meet(pairs, right, "b"), left, "a")
    return joined.select("a", "b", F.size(F.array_intersect("of_a", "of_b")).cast("long").alias("both"), (F.size("of_a") + F.size("of_b")).cast("long").alias("sum")).select("a", "b", "both", (F.col("sum") - F.col("both")).alias("any"))


def compared(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The members (``id``, ``rank``) of each bucket (``table_key``) with its heads, on full sets: ``a``, ``b``, ``both``,
    ``any``, so that both of each pair that is linked and shares a bucket are at least 0.2 alike to one head, or one is a head.

    The first head is the member that meets most others. Distances are a metric: what is linked to a member at least
    ``1.2 - percent / 100`` alike to a head is itself 0.2 alike to it. So such members and the heads leave the bucket.
    Unless the others are all 0.2 alike to one head, they go through a further round, with up to eight times as many
    heads, those first that are below 0.2 to all; a bucket ends when one member is left at most. Heads are maxima over parts of a bucket, so none is gathered.
    """
    spark, tolds, most, rest = members.sparkSession, [], 1, members.withColumn("rank", F.struct(F.lit(True).alias("far"), "rank.meets", "rank.back"))
    while True:
        part = F.expr(f"pmod(xxhash64(id, {most}), {most})")
        heads = rest.groupBy("table_key", part.alias("part")).agg((-F.max("rank")["back"]).alias("head")).drop("part")
        if most > 1:
            heads = materialise(heads, "heads")
        asked = meet(rest, heads, "table_key").where("id != head").withColumns({"a": F.least("id", "head"), "b": F.greatest("id", "head")})
        told = materialise(_confirmed(asked.select("a", "b").distinct(), sets), "confirmed")
        tolds.append(told)
        release(spark)
        low = materialise(meet(asked, told.where("5 * both < any").select("a", "b"), ["a", "b"]).select("table_key").distinct(), "open")
        if not low.limit(1).count():
            break
        judged = meet(meet(asked, low, "table_key", "left_semi"), told, ["a", "b"]).select("table_key", "id", "head", "rank", F.expr("5 * both >= any").alias("fringe"), F.expr(f"100 * both >= {120 - percent} * any").alias("core"))
        judged = materialise(judged, "judged")
        left = judged.groupBy("table_key", "id").agg(F.max("core").alias("core"), F.max("fringe").alias("fringe"), F.max("rank").alias("rank")).where("not core")
        left = materialise(meet(left, heads.select("table_key", F.col("head").alias("id")), ["table_key", "id"], "left_anti"), "left")
        # a bucket of which one head has all that is left in its cluster is done
        held = meet(judged, left.select("table_key", "id"), ["table_key", "id"]).groupBy("table_key", "head").agg(F.min("fringe").alias("all")).where("all").select("table_key").distinct()
        several = left.groupBy("table_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("table_key")
        rest = meet(meet(left, several, "table_key", "left_semi"), held, "table_key", "left_anti")
        rest = materialise(rest.select("table_key", "id", F.struct((~F.col("fringe")).alias("far"), "rank.meets", "rank.back").alias("rank")), "rest")
        if not rest.limit(1).count():
            break
        most *= 8
    every = tolds[0]
    for more in tolds[1:]:
        every = every.unionByName(more)
    return every


def least_alike(length: int, percent: int) -> int:
    """Equal bytes that two sketches of ``length`` bytes have if the sets are ``percent`` alike: five deviations below the
    mean, so that one pair in three million at that likeness has fewer."""
    p = percent / 100
    return max(0, int(length * p - 5 * (length * p * (1 - p)) ** 0.5))


def perhaps_alike(sketches: np.ndarray, labels: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
    """Whether each text has a partner of another label in the other block (``first`` tells which; one block: in it) with
    ``least`` equal bytes of the sketch."""
    left, right = (np.flatnonzero(first), np.flatnonzero(~first)) if not first.all() else (np.arange(len(labels)), np.arange(len(labels)))
    out, across = np.zeros(len(labels), bool), np.ascontiguousarray(sketches[right].T)
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        same = np.zeros((len(rows), len(right)), np.uint16)
        for c, theirs in enumerate(across):
            same += sketches[rows, c][:, None] == theirs[None, :]
        near = (same >= least) & (labels[rows][:, None] != labels[right][None, :])
        out[rows] |= near.any(axis=1)
        out[right] |= near.any(axis=0)
    return out


def links_between(ids: np.ndarray, labels: np.ndarray, first: np.ndarray, sets: pa.ListArray, percent: int) -> list[tuple[int, int]]:
    """Links between two blocks of texts (``first`` tells which; one block: within it) that join different labels:
    a spanning set of them. Sizes of all intersections come from products of 0/1 matrices, a slice of shingles at a time;
    shingles of one text alone can't count."""
    flat, ends = sets.flatten().to_numpy(), sets.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    sizes = np.diff(ends)
    names, coded, seen = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.cumsum(seen > 1) - 1
    row = np.repeat(np.arange(len(ids)), sizes)
    kept = seen[coded] > 1
    row, column = row[kept], shared[coded[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    left, right = (np.flatnonzero(first), np.flatnonzero(~first)) if not first.all() else (np.arange(len(ids)), np.arange(len(ids)))
    both = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(shared[-1]) + 1 if len(shared) else 0, 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        held = np.zeros((len(ids), 4096), np.float32)
        held[row[a:b], column[a:b] - low] = 1
        both += held[left] @ held[right].T
    both = both.astype(np.int64)
    near = 100 * both >= percent * (sizes[left][:, None] + sizes[right][None, :] - both)
    near &= labels[left][:, None] != labels[right][None, :]
    parent = {int(x): int(x) for x in labels}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for x, y in zip(*np.nonzero(near), strict=True):
        p, q = top(int(labels[left[x]])), top(int(labels[right[y]]))
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((int(ids[left[x]]), int(ids[right[y]])))
    return out


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, halves: int = 16, rows: int = 3, block: int = 512, block_shingles: int = 250_000, wide: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id (an integer), n_shingles, component_id (least id reachable over links), kept.

    Two texts are linked if 100 * |intersection| >= percent * |union| of their distinct ``width``-word shingles.

    * Rows with equal sets fall together by a digest; the rest works on one representative for each set.
    * Tensored banding: two collections of ``halves`` half-bands of ``rows`` minhashes make ``halves ** 2`` tables
      of ``2 * rows`` minhashes each, of ``2 * halves * rows`` minhashes instead of ``2 * halves ** 2 * rows``. A pair
      that is J alike shares a table with probability (1 - (1 - J ** rows) ** halves) ** 2: all but 0.00002 at 0.8.
      Table keys are formed only from half-bands that some other set shares, so most sets form none.
    * In each bucket all members are compared with its head, the one that meets most others, on full sets; links give
      components. Texts that are at least 0.2 alike to common heads form clusters. What a head leaves open gets further heads,
      until all linked pairs of a bucket are in one cluster. A cluster of one component is done.
    * In the others, first sketches of a byte for each minhash are compared, ``wide`` by ``wide`` texts a task: a linked pair
      has fewer equal bytes than ``least_alike`` with probability 0.0000003. Pages that share a template alone drop out here, at
      a hundred bytes a text. Texts with a partner of another component are compared exactly, ``block`` by ``block`` texts a
      task, or fewer that have about ``block_shingles`` shingles, which hands on a spanning set of the links that join
      components. So no table of pairs arises, and a group of near copies of any size is split over tasks.
    * Components come from minima that travel along links. Buckets' minima and counts are taken before each exchange;
      no bucket is ever gathered in one task.

    Null or empty texts have no shingle and are linked with nothing; rows that share an id are one node, which has the
    shingles of all its texts; rows without id are judged each by its own text, and their id gives way to any other
    and stays null, also as that of a component without ids; ties can't arise, as ids are ordered; an empty table gives no rows;
    other columns aren't read.
    """
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`").cast("string")
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"), F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))).alias("tag"))
    measured = materialise(measure(narrow, width, halves, rows), "minhashes")
    # ids whose rows differ in their sets; the null digest of an empty set counts as one
    torn = measured.where("id is not null").groupBy("id").agg(F.min(F.xxhash64("digest")).alias("low"), F.max(F.xxhash64("digest")).alias("high")).where("low != high").select("id")
    torn, united = materialise(torn, "torn"), None
    if torn.limit(1).count():
        united = materialise(unite(meet(narrow, torn, "id", "left_semi"), width), "united")
        whole = meet(measured.select("id"), measure_united(united, halves, rows), "id").withColumn("tag", F.lit(None).cast("binary"))
        measured = materialise(meet(measured, torn, "id", "left_anti").unionByName(whole), "minhashes")
    filled = measured.where("n_shingles > 0")
    # a set has the same keys wherever it stands; ``source`` tells a row that holds it, without tag the united one of an id
    same = filled.groupBy("digest").agg(F.min(F.struct("id", "tag")).alias("source"), F.min("id").alias("least"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    classes = materialise(same.withColumn("node", F.monotonically_increasing_id()), "classes")
    keys = classes.select(F.col("node").alias("id"), F.posexplode("keys").alias("slot", "key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    live = meet(keys, shared, "key").groupBy("id").agg(F.collect_list(F.when(F.col("slot") < halves, F.col("key"))).alias("one"), F.collect_list(F.when(F.col("slot") >= halves, F.col("key"))).alias("two"))
    tables = live.where("size(two) > 0").select("id", "two", F.explode("one").alias("left_key")).select("id", "left_key", F.explode("two").alias("right_key")).select("id", F.xxhash64("left_key", "right_key").alias("table_key"))
    tables = materialise(tables, "table-keys")
    sizes = tables.groupBy("table_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = materialise(meet(tables, sizes, "table_key"), "held")
    rank = held.groupBy("id").agg(F.struct(F.sum("n").alias("meets"), (-F.col("id")).alias("back")).alias("rank"))
    members = materialise(meet(held.select("table_key", "id"), rank, "id"), "buckets")
    nodes = rank.select("id")
    sources = meet(classes, nodes, classes["node"] == nodes["id"], "left_semi").select("node", F.col("source.id").alias("source_id"), F.col("source.tag").alias("source_tag"))
    stands = F.col("id").eqNullSafe(F.col("source_id")) & (F.col("tag") == F.col("source_tag"))
    sets = shingle_sets(meet(narrow, sources, stands).select(F.col("node").alias("id"), "text"), width).dropDuplicates(["id"])
    if united is not None:
        sets = sets.unionByName(meet(united, sources.where("source_tag is null"), F.col("id") == F.col("source_id")).select(F.col("node").alias("id"), "shingles"))
    sets = materialise(sets.withColumn("size", F.size("shingles")), "sets")
    release(spark)
    near = F.expr(f"100 * both >= {percent} * any")
    told = compared(members, sets, percent)
    links = told.where(near).select("a", "b")
    labels = components(links)
    # what the heads leave open: clusters of several components
    clusters = components(told.where("5 * both >= any").select("a", "b")).select("id", F.col("component").alias("cluster"))
    placed = meet(clusters, labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy("cluster").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count(F.lit(1)) / wide).cast("int").alias("blocks")).where("low != high").select("cluster", "blocks")
    placed = meet(meet(placed, mixed, "cluster"), classes.select(F.col("node").alias("id"), "sketch"), "id")
    own, other = F.expr("cast(pmod(xxhash64(id), blocks) as int)"), F.explode(F.expr("sequence(0, blocks - 1)"))
    dealt = placed.withColumn("own", own).withColumn("other", other)
    dealt = dealt.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "component", "sketch")
    least = least_alike(2 * halves * rows, percent)

    def sketched(key: tuple, table: pa.Table) -> pa.Table:
        sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(table.num_rows, -1)
        kept = perhaps_alike(sketches, table.column("component").to_numpy(), table.column("own").to_numpy() == key[1].as_py(), least)
        return table.drop_columns(["sketch"]).filter(pa.array(kept))

    closer = dealt.groupBy("cluster", "i", "j").applyInArrow(sketched, "cluster long, i int, j int, own int, id long, component long")
    closer = materialise(meet(closer, sets.select("id", "size"), "id"), "closer")
    shares = closer.groupBy("cluster", "i", "j", "own").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("size") / block_shingles)).cast("int").alias("parts"))
    shares = shares.groupBy("cluster", "i", "j").agg(F.max("parts").alias("parts"))
    cut = meet(closer, shares, ["cluster", "i", "j"]).withColumn("part", F.expr("cast(pmod(xxhash64(id, 7L), parts) as int)")).withColumn("across", F.explode(F.expr("sequence(0, parts - 1)")))
    # of two blocks each part of one meets each of the other, of one block each part each other once
    lone = F.col("i") == F.col("j")
    p = F.when(lone, F.least("part", "across")).when(F.col("own") == F.col("i"), F.col("part")).otherwise(F.col("across"))
    q = F.when(lone, F.greatest("part", "across")).when(F.col("own") == F.col("i"), F.col("across")).otherwise(F.col("part"))
    side = F.when(lone, F.col("part") == p).otherwise(F.col("own") == F.col("i"))
    cut = meet(cut.select("cluster", "i", "j", p.alias("p"), q.alias("q"), side.alias("first"), "id", "component"), sets.select("id", "shingles"), "id")

    def linked(key: tuple, table: pa.Table) -> pa.Table:
        found = links_between(table.column("id").to_numpy(), table.column("component").to_numpy(), table.column("first").to_numpy(), table.column("shingles").combine_chunks(), percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    more = cut.groupBy("cluster", "i", "j", "p", "q").applyInArrow(linked, "a long, b long")
    every = materialise(links.unionByName(more), "links")
    release(spark)
    found = components(every)
    label = meet(classes, found, classes["node"] == found["id"], "left").select("digest", "least", F.coalesce("component", "node").alias("component"))
    named = label.groupBy("component").agg(F.min("least").alias("component_id"))
    out = meet(measured.select("id", "n_shingles", "digest"), meet(label, named, "component").select("digest", "component_id"), "digest", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
