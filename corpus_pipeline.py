"""From raw documents to model input: five stages over whole tables, each on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet below the shared
checkpoint folder and read again, so a stage never depends on executors that ran an earlier one. All stages but the last
return the columns of ``docs``.

Every stage takes nulls in any column, empty and very long texts (whole), repeated rows and further columns of any name, and gives an
empty table for one; what that means for its decision is said in each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelwatch.llm import decontamination, minhash, quality_classifier, secret_scans, sentence_pieces
from modelwatch.llm.common import packed, row_key, stored, table, unpacked


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier finds bad or toxic.

    A null or empty text is judged as it is; rows that repeat a text share its fate; labels with a null id or verdict do not count.
    """
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: 5-word shingles, similarity 0.8.

    The smallest id stays, null ids last; rows that repeat it are one. Documents without words are no duplicates of each other.
    """
    return minhash.drop_near_duplicates(docs, width=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that share a window with the benchmark.

    Documents and items without words share nothing; rows that repeat a document go or stay together.
    """
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    hit = found.where("contaminated").select("key").distinct()
    return packed(docs, key=row_key("doc_id", "text")).join(hit, "key", "left_anti").select(*unpacked("row", docs.columns))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace live-looking credentials; documents stay. The number of characters follows the text, null stays null.

    Null and empty texts have nothing to replace; a null source is an owner of its own; repeated rows are masked alike.
    """
    repository = F.concat_ws("/", F.col("source"), F.col("lang"))
    masked = secret_scans.mask_secrets(docs, owner=F.col("source"), repository=repository)
    size = F.coalesce(F.length("text").cast("long"), F.col("n_chars"))
    return masked.withColumn("n_chars", F.when(F.col("n_chars").isNull(), F.col("n_chars")).otherwise(size)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every document; decoding them gives the text back.

    Null and empty texts have no pieces; rows that repeat an id and a text get equal pieces.
    """
    return sentence_pieces.encode_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", mask_secrets),
    ("SentencePiece encoding", encode),
]

#: SQL can express neither the classifier nor the sampled segmentation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
