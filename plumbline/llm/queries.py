"""The queries of the corpus operators over the whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.decontamination import contaminated_spans, n_hit

    found = contaminated_spans(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit() > 0).alias("contaminated"))


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
m AS (SELECT rid, dw.n, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM m) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN it USING (rid)
"""


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.sharding import shard_uniformly

    placed = shard_uniformly(_table(spark, sf_dir, "documents"), 24)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    return placed.select("doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), width=4)


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS reach FROM d UNION SELECT r.id, u.b FROM r JOIN u ON r.reach = u.a),
c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.packing import pack

    pieces = pack(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.labelled import held_out
    from plumbline.llm.quality import score_quality, train

    docs = _table(spark, sf_dir, "documents")
    scored = score_quality(docs.select("doc_id", "text"), train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.fingerprints import fingerprint, likeness, packed

    made = fingerprint(_table(spark, sf_dir, "documents"))
    return made.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), packed("bins").alias("fingerprint"), packed("edited_bins").alias("edited_fingerprint"), likeness("bins", "edited_bins").alias("near_edited"), likeness("bins", "next_bins").alias("near_next"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.labelled import held_out
    from plumbline.llm.toxicity import score_toxicity, train

    docs = _table(spark, sf_dir, "documents")
    scored = score_toxicity(docs.select("doc_id", "text"), train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.sstable import read_tables, write_tables

    shards = write_tables(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=2)
    return read_tables(spark, shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.substring_dedup import plain_words, remove_repeats

    cleaned = remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(plain_words().cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT rid, i, hash(w[i:i + 34]) AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT k FROM k GROUP BY k HAVING count(*) > 1),
g AS (SELECT rid, list(DISTINCT p) AS gone FROM (SELECT rid, unnest(range(i, i + 35)) AS p FROM k JOIN r USING (k)) GROUP BY rid),
u AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
c AS (SELECT u.rid, string_agg(word, ' ' ORDER BY u.p) FILTER (x.p IS NULL) AS kept, count(x.p) AS n_removed FROM u LEFT JOIN (SELECT rid, unnest(gone) AS p FROM g) x ON u.rid = x.rid AND u.p = x.p GROUP BY u.rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN c USING (rid)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_decontamination": op2_decontamination,
    "op3_sharding": op3_sharding,
    "op4_near_dedup": op4_near_dedup,
    "op5_packing": op5_packing,
    "op6_quality": op6_quality,
    "op7_fingerprints": op7_fingerprints,
    "op8_toxicity": op8_toxicity,
    "op9_sstable": op9_sstable,
    "op10_substring_dedup": op10_substring_dedup,
}
SQL: dict[str, str] = {"op2_decontamination": OP2_SQL, "op4_near_dedup": OP4_SQL, "op10_substring_dedup": OP10_SQL}
