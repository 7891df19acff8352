"""The corpus pipeline: toxicity, line dedup, near-dedup, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All stages but the last return the columns of documents, and only
these: other columns of ``docs``, whatever their names, are left out. All take empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.llm.common import DOC_COLUMNS, fresh, read, shared_folder
from panelwise.llm.decontaminate import drop_contaminated
from panelwise.llm.lines import dedup_lines
from panelwise.llm.mixing import mixed_documents
from panelwise.llm.neardup import drop_near_duplicates
from panelwise.llm.toxicity import drop_toxic, train_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity score rejects; learns from the labelled ones among ``docs``.

    Null and empty texts have the score of the bias and stay. Repeated rows share their fate, rows
    without a doc_id are scored as any. Without labels of both kinds nothing is rejected.
    """
    return drop_toxic(docs, train_toxicity(docs, read(spark, sf_dir, "labels"))).select(*DOC_COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated chunks of lines. A document all of whose words go was a copy and goes with them.

    Null and empty texts stay as they are. Rows of equal doc_id and text are one document and all get
    its result. The smallest doc_id, null before all, keeps a chunk. n_chars is counted anew.
    """
    cleaned = dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return cleaned.filter(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", F.length("text").cast("long")).select(*DOC_COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: of the smallest doc_id, rows without one last.

    Of rows with equal doc_id and text one stays. Null texts and texts without words stay, all of them.
    """
    return drop_near_duplicates(docs).select(*DOC_COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of the benchmark. Null texts hold none; repeated rows share their fate; an empty benchmark drops nothing."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark")).select(*DOC_COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target, copies and taken.

    Documents without words are taken 0 times and left out. Repeated rows are documents of their own
    and come as one row with the sum of their copies. Equal places in the queue go by source, copy
    and hash. A null source is one of the sources.
    """
    return mixed_documents(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing)]

#: A trained model and near-duplicate groups are not SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/{fresh(name)}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
