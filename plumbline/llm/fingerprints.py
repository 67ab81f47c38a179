"""One-permutation MinHash fingerprints in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS, BIN_BITS, LOW_BITS, VALUE_BITS, PROBES, WORDS = 256, 8, 8, 55, 16, 5
_EMPTY = (1 << VALUE_BITS) - 1
_CHANCE = 2.0**-LOW_BITS


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: the ``BINS`` low-order bytes of the text's minima, null for a text without words.

    Words are parted at white space, shingles are ``WORDS`` words (fewer words: all of them as one) and hashed
    once to 63 bits, of which the top ``BIN_BITS`` choose the bin. One sort, with a sentinel for each bin, leaves
    the minima in bin order. An empty bin takes the value of the first filled one on its own fixed sequence of
    pseudo-random bins (optimal densification); after ``PROBES`` of them, of the filled bin with the least hash
    for this bin, which follows the same law. So bins agree between texts with the probability of their likeness.
    """
    steps = f"sequence(0, {BINS - 1})"
    trimmed = F.expr(f"regexp_replace(coalesce(`{text}`, ''), '^\\\\s+|\\\\s+$', '')")
    words = df.withColumn("_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"\s+")))
    hashed = words.withColumn("_words", F.expr("transform(_words, w -> xxhash64(w))"))
    gets = ", ".join(f"get(_words, i + {j})" for j in range(WORDS))
    keys = f"transform(sequence(0, greatest(size(_words) - {WORDS}, 0)), i -> xxhash64({gets}) & {(1 << 63) - 1}L)"
    sentinels = f"transform({steps}, i -> shiftleft(cast(i as bigint), {VALUE_BITS}) | {_EMPTY}L)"
    sorted_ = hashed.withColumn("_keys", F.expr(f"if(size(_words) = 0, null, sort_array(concat({keys}, {sentinels})))")).drop("_words")
    firsts = sorted_.withColumn("_keys", F.expr(f"filter(_keys, (x, i) -> i = 0 or shiftright(x, {VALUE_BITS}) != shiftright(get(_keys, i - 1), {VALUE_BITS}))"))
    minima = firsts.withColumn("_minima", F.expr(f"transform(_keys, x -> nullif(x & {_EMPTY}L, {_EMPTY}L))")).drop("_keys")
    filled = minima.withColumn("_filled", F.expr(f"filter({steps}, i -> get(_minima, i) is not null and size(_minima) > 0)"))
    probes = ", ".join(f"get(_minima, cast(pmod(xxhash64(i, {a}), {BINS}) as int))" for a in range(PROBES))
    least = f"get(_minima, cast(array_min(transform(_filled, j -> shiftleft(shiftrightunsigned(xxhash64(i, j), {BIN_BITS + 1}), {BIN_BITS}) | if(size(_filled) > 0, j, 0))) & {BINS - 1} as int))"
    dense = f"transform({steps}, i -> cast((coalesce(get(_minima, i), {probes}, {least}) & {(1 << LOW_BITS) - 1}) - {1 << (LOW_BITS - 1)} as tinyint))"
    return filled.withColumn(out, F.expr(f"if(_minima is null, null, {dense})")).drop("_minima", "_filled")


def packed(bins: str) -> Column:
    """The fingerprint as hexadecimal text, two digits a bin; empty for a text without words."""
    table = ", ".join(f"'{b:02x}'" for b in range(1 << LOW_BITS))
    return F.expr(f"coalesce(array_join(transform({bins}, b -> get(array({table}), b + {1 << (LOW_BITS - 1)})), ''), '')")


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard likeness of the shingle sets: the share of equal bins, less what chance makes equal.
    Two texts without words are alike, one and another aren't."""
    same = f"aggregate(zip_with({a}, {b}, (x, y) -> if(x = y, 1, 0)), 0, (n, x) -> n + x)"
    share = F.expr(same) / F.lit(float(BINS))
    known = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (share - _CHANCE) / (1 - _CHANCE)))
    return F.when(F.col(a).isNull() & F.col(b).isNull(), 1.0).when(F.col(a).isNull() | F.col(b).isNull(), 0.0).otherwise(known)


def _cell(id_col: str, bounds: list, cells: int) -> Column:
    """The cell of a row: the range of its id between ``bounds``, found by bisection in the expression, cut in equal widths;
    grows with the id. A range of one id alone, and rows without id, are cut by ``tie`` instead, the least in the last cell."""
    by_tie = F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor((F.col("tie").cast("double") / 2.0**64 + 0.5) * cells))).cast("long")

    def within(low: int, high: int) -> Column:
        if high - low == 1:
            a, b = bounds[low], bounds[high]
            if b - a == 1:
                return F.lit((low + 1) * cells - 1).cast("long") - by_tie
            inner = F.floor((F.col(id_col).cast("double") - float(a)) * (cells / max(1.0, float(b) - float(a))))
            return F.lit(low * cells).cast("long") + F.greatest(F.lit(0), F.least(F.lit(cells - 1), inner))
        middle = (low + high) // 2
        return F.when(F.col(id_col) < bounds[middle], within(low, middle)).otherwise(within(middle, high))

    return F.when(F.col(id_col).isNull(), F.lit(-1).cast("long") - by_tie).otherwise(within(0, len(bounds) - 1))


def with_next(docs: DataFrame, id_col: str, text_col: str, bins: str, measured, ranges: int = 128, rows_a_cell: int = 2048, most_cells: int = 1 << 20) -> DataFrame:
    """``docs`` (id, text) with ``bins``, which ``measured`` adds, and the next row's text and bins in descending id order,
    the first's after the last.

    Ids are cut into cells in id order: quantile ranges, each in equal widths. A window orders each cell; a copy
    of the next cell's first row, a ghost, ends it. So there is one shuffle of the rows by cell and no global sort.
    The ghosts' ids, at most ``most_cells``, are broadcast; they are ordered by one task. An id that fills several quantiles
    is a range of its own, whose rows, like those without id, are parted by their texts' hash; only rows that are alike in id and
    text can't be parted.
    """
    shares = ", ".join(str(i / ranges) for i in range(1, ranges))
    low, high, rows, middle = docs.agg(F.min(id_col), F.max(id_col), F.count(F.lit(1)), F.expr(f"approx_percentile(`{id_col}`, array({shares}), 10000)")).first()
    hot = {a for a, b in zip(middle or [], (middle or [])[1:], strict=False) if a == b}
    bounds = sorted({*(middle or []), *(h + 1 for h in hot), *([] if low is None else [low, high + 1])}) or [0, 1]
    cells = max(1, min(most_cells // len(bounds), -(-rows // (rows_a_cell * (len(bounds) - 1)))))
    if len(bounds) > 2 and rows < rows_a_cell * (len(bounds) - 1):
        step = max(1, rows_a_cell * (len(bounds) - 1) // max(rows, 1))
        bounds = [*bounds[:-1:step], bounds[-1]]
    placed = docs.withColumn("tie", F.xxhash64(text_col)).withColumn("cell", _cell(id_col, bounds, cells)).withColumn("ghost", F.lit(0))
    heads = placed.groupBy("cell").agg(F.max(id_col).alias("head"))
    down = Window.orderBy(F.desc("cell"))
    before = F.coalesce(F.lag("cell").over(down), F.min("cell").over(Window.partitionBy()))
    wanted = heads.select("head", "cell", before.alias("goes_to"))
    match = placed.alias("p").join(F.broadcast(wanted.alias("w")), F.expr(f"p.`{id_col}` <=> w.head and p.cell = w.cell"))
    first = F.min_by(F.struct(f"p.{id_col}", f"p.{text_col}"), F.struct("p.tie", f"p.{text_col}"))
    ghosts = match.groupBy("goes_to").agg(first.alias("row")).select("row.*", F.col("goes_to").alias("cell"), F.lit(1).alias("ghost"), F.lit(0).cast("long").alias("tie"))
    order = Window.partitionBy("cell").orderBy("ghost", F.desc_nulls_last(id_col), "tie", text_col)
    both = measured(placed).unionByName(measured(ghosts))
    seen = both.withColumn("next_text", F.lead(text_col).over(order)).withColumn("next_bins", F.lead(bins).over(order))
    return seen.where("ghost = 0").drop("cell", "ghost", "tie")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id (an integer), text, fingerprint bins, next document's text and bins, edited text and its bins.

    The edited text has its last floor(n / 2) of n code points replaced by as many first ones (or all) of the next
    document in descending id order. Null text is empty: its bins are null, it is alike only to other empty ones.
    Rows that share an id follow each other by their texts' hash; null ids come last; an empty table gives no
    rows; a single row is its own next one. Other columns aren't read.
    """
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    chained = with_next(narrow, "doc_id", "text", "bins", lambda df: with_fingerprint(df, "text", "bins"))
    half = F.expr("char_length(text) div 2")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - char_length(text) div 2)"), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half.cast("int")))
    return with_fingerprint(chained.withColumn("edited", edited), "edited", "edited_bins")
