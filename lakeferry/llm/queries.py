"""The registered queries of the corpus operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeferry.llm.base import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of each document. Null texts have no words; repeated rows are counted each; without items or documents there is nothing to find."""
    from lakeferry.llm.decontam import Decontaminator, report

    return report(table(spark, sf_dir, "documents"), Decontaminator(table(spark, sf_dir, "benchmark")))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of each vector. Null, zero and non-finite vectors and rows without a label are alone; a null id counts as a link, and as a component's id only where there is no other."""
    from lakeferry.llm.embed_dedup import report

    return report(table(spark, sf_dir, "embeddings"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document. Null and empty texts have fingerprint zero, linked like any other; repeated rows are returned each."""
    from lakeferry.llm.simhash import report

    return report(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of each document. Null and empty texts have none; texts are scanned whole; other columns are ignored."""
    import public_tokenizers

    from lakeferry.llm.credentials import SecretScan, report

    return report(table(spark, sf_dir, "documents"), SecretScan(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each document, null and empty ones too. Labels of documents that are held out, and rows without a label or an id, teach nothing."""
    from lakeferry.llm.toxicity import report

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document; null texts and those without a letter are `und`. Documents that are held out, and those without a language, teach nothing."""
    from lakeferry.llm.langid import report

    return report(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each document by its text, its metadata and both; null texts and metadata are values of their own."""
    from lakeferry.llm.quality import report

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The key of the registered query and of the pipeline; a deployment passes its own.
PII_KEY = b"lakeferry registered query"


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text with pseudonyms, and where they went, of each document. Null stays null, empty empty."""
    from lakeferry.llm.pii import Pseudonymiser, report

    return report(table(spark, sf_dir, "documents"), Pseudonymiser(spark, PII_KEY))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and of what they decode to, of each document; null counts as empty."""
    import public_tokenizers

    from lakeferry.llm.bpe import ByteBPE, digest

    bpe = ByteBPE(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return digest(table(spark, sf_dir, "documents"), bpe)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document. Null texts have no bytes and stay together like equal ones; rows that repeat have slots of their own."""
    from lakeferry.llm.sharding import shard_rows

    return shard_rows(table(spark, sf_dir, "documents"))


def secrets_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op4_secrets that SQL can express."""
    return op4_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op9_byte_bpe that SQL can express: what ids decode to."""
    return op9_byte_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


def sharding_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op10_sharding: sizes, that equal texts share a shard, that slots have no gaps, and that sizes are near equal
    (no shard holds over 1 % more than another, but for what its largest group makes unavoidable)."""
    rows = op10_sharding(spark, sf_dir)
    texts = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    split = rows.join(texts, "doc_id").groupBy("digest").agg(F.count_distinct("shard").alias("n"), F.sum("size").alias("bytes")).agg(F.max("n").alias("n"), F.max("bytes").alias("largest"))
    shards = rows.groupBy("shard").agg(F.sum("size").alias("bytes"), (F.max("slot") + 1 - F.count("*")).alias("gaps"))
    shards = shards.agg(F.sum("bytes").cast("long").alias("bytes"), F.sum("gaps").cast("long").alias("gaps"), (F.max("bytes") - F.min("bytes")).alias("spread"))
    near = F.col("spread") <= F.greatest(F.col("bytes") / 1600, F.col("largest"))
    return shards.join(split, F.lit(True)).select("bytes", "gaps", F.col("n").alias("shards_of_a_text"), near.alias("near_equal"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five stages over the documents; what each does with odd rows is said there."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_simhash": op3_simhash,
    "op4_secrets": op4_secrets,
    "op5_toxicity": op5_toxicity,
    "op6_language": op6_language,
    "op7_quality": op7_quality,
    "op8_pii": op8_pii,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_sharding": op10_sharding,
    "pipeline": pipeline,
    "secrets_counted": secrets_counted,
    "bpe_round_trip": bpe_round_trip,
    "sharding_held": sharding_held,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), grams AS (
    SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(8, len(w)) AS n, array_to_string(w[i : i + least(8, len(w)) - 1], ' ') AS gram
    FROM b, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - 7))) AS i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM grams), seen AS (
    SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS gram
    FROM d, sizes, LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS i) WHERE len(w) >= n
), hit AS (
    SELECT seen.doc_id, seen.i, seen.n, grams.item FROM seen JOIN grams USING (n, gram)
), covered AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS place FROM hit) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list_distinct(list(item))), ',') AS ids FROM hit GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
""",
    "secrets_counted": r"""
SELECT doc_id,
       CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: len(x) >= 6)) AS BIGINT) AS n_assign,
       CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: len(x) >= 20)) AS BIGINT) AS n_access,
       CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: len(x) >= 24)) AS BIGINT) AS n_hex
FROM documents
""",
    "bpe_round_trip": "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents",
    "sharding_held": "SELECT CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS gaps, CAST(1 AS BIGINT) AS shards_of_a_text, true AS near_equal FROM documents",
    "op2_embedding_dedup": """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), linked AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
    SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN linked l ON r.y = l.x
), least AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x),
many AS (SELECT x AS vec_id, count(*) AS n FROM linked GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN many USING (vec_id)
""",
}
