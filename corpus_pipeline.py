"""The corpus pipeline: five stages over ``documents``, each one operator of the corpus subpackage.

Every stage but the last returns the columns of ``documents``, whatever else they are named, and works on all that its
predecessor kept. In all stages null text is empty, null ids are ids like others, equal rows are rows of their own, an
empty table gives an empty one, and further columns pass (the last stage doesn't read them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import free_names, kept_alone, materialise, meet
from plumbline.llm.decontamination import contaminated_spans
from plumbline.llm.near_dedup import near_duplicates
from plumbline.llm.packing import pack
from plumbline.llm.quality import score_quality, train
from plumbline.llm.substring_dedup import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.7 go; one of 0.7 stays, as one that can't be told apart from such does
    (without labels of both kinds all score 0.7). It learns from the labelled rows of ``docs``. Texts that are null or
    empty are scored by their form, like others."""
    (score,) = free_names(docs, "score")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model, score_col=score).where(F.col(score) >= 0.7).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) one row stays, that of the least id (null ids last); of rows that
    share it, the least by a hash of the text. Rows are told apart by a key of their own, not by id: copies with the same
    id or without one are copies like any other. Texts without words are no copies of each other and stay."""
    (row,) = free_names(docs, "row")
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    # rows alike in both are parted by their place, so that many of them aren't sorted by one task
    placed = docs.withColumn(row, F.monotonically_increasing_id()).orderBy(*order, F.col(row))
    keyed = materialise(placed.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = near_duplicates(keyed, id_col=row).where("not kept").select(row)
    return meet(keyed, found, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that also start elsewhere lose their words; ``n_chars`` follows the text, and
    documents that lose all their words go. Those without words stay."""
    removed, words = free_names(docs, "removed", "words")
    left = remove_repeats(docs, window=50, removed_col=removed, words_col=words)
    kept = left.where((F.col(removed) == 0) | (F.col(removed) < F.col(words)))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(removed) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or all of a shorter one, go; of rows that share an
    id, those whose text does. Without items all stay."""
    found = contaminated_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("size(items) > 0")
    other, tag = free_names(docs, "id", "tag")
    hit = found.select(F.col("doc_id").alias(other), F.col("tag").alias(tag)).distinct()
    same = docs["doc_id"].eqNullSafe(hit[other]) & (F.xxhash64(docs["text"]) == hit[tag])
    return docs.join(hit, same, "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of at most 2048; a text that is null or empty is its end id alone."""
    import public_tokenizers

    pieces = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("packing", packing)]

#: No SQL: a trained classifier and a tokenizer take part.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each stage's result is a table; what led to it is removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept_alone(spark, lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
