"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns what the next one works on; run() writes each result to the shared
folder and rereads it, so a lost executor costs one stage at most. All stages but the last keep the columns of
documents; n_chars follows the text. Documents that lose all their text stay, with an empty one.

In every stage null texts count as empty, null and repeated ids and repeated rows are rows like others unless it says
otherwise, extra columns may have any name and come through all stages but the last, and an empty table gives an empty
one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactlake.llm import line_dedup, near, packing, quality, suffix_dedup
from redactlake.llm.common import Scratch, crc32_mod, fresh, tables_given_up
from redactlake.llm.queries import read, tokenizer_path

#: Documents of at least this probability of label 1 stay.
QUALITY = 0.3
#: Lines found in so many documents go.
LINE_DOCS = 10


def _with_text(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier, fitted on labelled documents that are not held out, rejects. Equal texts go or stay
    together; without labels nothing goes."""
    learn = read(spark, sf_dir, "labels").where(crc32_mod("doc_id", 5) != 0)
    model = quality.fit(*quality.sample(docs.select("doc_id", "text"), learn))
    score = fresh(docs, "_score")
    return quality.score(docs, model, to=score).where(F.col(score) >= QUALITY).select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines that many documents share. Rows of one id and text are one document; a null text that loses
    nothing becomes an empty one."""
    return _with_text(line_dedup.keep_lines(docs, line_dedup.keep_bitmaps(docs, min_docs=LINE_DOCS)), docs.columns, "_kept")


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity of 0.8) the document of the least id stays; rows
    without an id stay only where no row of their group has one. Rows of one id are one document."""
    found = near.near_duplicates(docs.select("doc_id", "text"))
    keep = found.where(F.col("doc").eqNullSafe(F.col("component"))).select(F.col("doc").alias("_doc")).distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["_doc"]), "left_semi")


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every string of 200 bytes that also stands elsewhere; of rows with equal texts of so many bytes nothing
    stays."""
    return _with_text(suffix_dedup.without_repeats(docs, as_text=True), docs.columns, "_kept")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 1024; an empty text is one piece, of the end token."""
    return packing.pack(docs, tokenizer_path()).withColumnRenamed("doc", "doc_id")


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("simhash near-dedup", one_of_near),
    ("suffix-array dedup", drop_repeats),
    ("best-fit packing", pack),
]

#: The classifier cannot be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with tables_given_up():
            docs = scratch.table(stage(spark, docs, sf_dir), str(k))
        scratch.drop(str(k - 1))
    return docs
