"""The query of each operator: production parameters, whole tables, the columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactlake.llm import ann, bpe, fingerprint, line_dedup, lm, packing, quality, simhash, suffix_dedup, warc
from redactlake.llm.common import crc32_mod

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), decoded="decoded")
    return df.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.keep_lines(df, line_dedup.keep_bitmaps(df, min_docs=10))
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score(df, crc32_mod("doc_id", 7) == 2).withColumnRenamed("doc", "doc_id")


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited(read(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("doc", "doc_id")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.without_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.col("_n_spans").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    """Fitted on labelled documents that are not held out."""
    learn = read(spark, sf_dir, "labels").where(crc32_mod("doc_id", 5) != 0)
    return quality.fit(*quality.sample(read(spark, sf_dir, "documents").select("doc_id", "text"), learn))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quality.score(read(spark, sf_dir, "documents").select("doc_id", "text"), quality_model(spark, sf_dir))
    return df.select("doc_id", (crc32_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.lookup(warc.write(pages), pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path()).withColumnRenamed("doc", "doc_id")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


#: In DuckDB: the lines of all documents (empty text for null) with their keys and the number of documents of each key.
LINES = """
    WITH parts AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
        FROM {documents}
    ), keyed AS (
        SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM parts
    ), often AS (
        SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
    ), marked AS (
        SELECT k.*, o.key IS NOT NULL AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key
    )"""

QUERIES = {"op1_bpe": op1_bpe, "op2_line_dedup": op2_line_dedup, "op3_lm": op3_lm, "op4_fingerprint": op4_fingerprint, "op5_suffix_dedup": op5_suffix_dedup, "op6_simhash": op6_simhash, "op7_quality": op7_quality, "op8_warc": op8_warc, "op9_packing": op9_packing, "op10_ann": op10_ann}

SQL: dict[str, str] = {
    "op2_line_dedup": LINES.format(documents="documents")
    + """
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id""",
    # Every window of 200 bytes, as hexadecimal digits.
    "op5_suffix_dedup": """
    WITH d AS (
        SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
    ), w AS (
        SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS k
        FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 199, 0))) AS i FROM d)
    ), often AS (
        SELECT k FROM w GROUP BY k HAVING count(*) > 1
    ), hit AS (
        SELECT doc_id, i, coalesce(i > lag(i) OVER p + 200, true) AS opens FROM w JOIN often USING (k) WINDOW p AS (PARTITION BY doc_id ORDER BY i)
    ), runs AS (
        SELECT doc_id, run, min(i) AS s, max(i) + 200 AS e FROM (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hit) GROUP BY doc_id, run
    ), cut AS (
        SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM runs
    ), kept AS (
        SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) || substr(any_value(h), 2 * max(e) + 1) AS h FROM cut JOIN d USING (doc_id) GROUP BY doc_id
    )
    SELECT d.doc_id, len(d.h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
    FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id""",
    "op8_warc": """
    WITH p AS (
        SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS sha FROM pages
    ), latest AS (
        SELECT sha, max(page_id) AS latest FROM p GROUP BY sha
    )
    SELECT page_id, octet_length(payload) AS payload_bytes,
           array_to_string([
               substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31), 1)
               for i in range(32)], '') AS payload_digest,
           CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> latest THEN latest END AS refers_to
    FROM p JOIN latest USING (sha)""",
}
