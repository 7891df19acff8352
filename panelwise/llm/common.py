"""Helpers shared by the corpus operators: row identity, lineage cuts, column lets."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a Java and Python character class body.
SPACE = r"\x20\x09-\x0D"
#: The columns of the documents table.
DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Name of the struct that carries the caller's row through an operator; a caller's column of
#: any other name cannot clash with what an operator adds.
ROW = "__llm_row"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the given directory, by Spark's reader alone."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of our own in local mode, and an error on a cluster."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Computes ``df`` once and cuts its lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def row_ids(first: str = "r1", second: str = "r2") -> tuple[Column, Column]:
    """Identity of a document row, by two 64-bit hashes of its doc_id and text in either order: rows equal in both count as one document. Never null."""
    id_, text = F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00")), F.coalesce(F.col("text"), F.lit("\x00"))
    return F.xxhash64(id_, text).alias(first), F.xxhash64(text, id_, F.lit(1)).alias(second)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often a lambda inside ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(name: str) -> str:
    """A name that no other call gets."""
    return f"__{name}_{uuid.uuid4().hex[:8]}"


def keep_row(df: DataFrame, *columns: Column) -> DataFrame:
    """The caller's whole row as one struct, beside the columns that an operator works with."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW), *columns)


def narrow(df: DataFrame, key: str, ids: DataFrame, bits: int = 23) -> DataFrame:
    """Rows of ``df`` whose long ``key`` may be in the first column of ``ids``: all that are, and few others.

    A bitmap of 2 ** bits bits, a fixed size whatever the number of ids, is broadcast as rows of 64
    bits. It saves the shuffle of the other rows ahead of an exact join; it decides nothing.
    """
    name = ids.columns[0]
    word = lambda c: F.pmod(F.xxhash64(F.col(f"`{c}`")), F.lit((1 << bits) // 64))
    bit = lambda c: F.expr(f"shiftleft(1L, cast(shiftright(xxhash64(`{c}`), 40) & 63L as int))")
    words = ids.groupBy(word(name).alias("__word")).agg(F.bit_or(bit(name)).alias("__bits"))
    at = df.withColumn("__at", word(key)).withColumn("__bit", bit(key))
    hit = at.join(F.broadcast(words), (at["__at"] == words["__word"]) & (at["__bit"].bitwiseAND(words["__bits"]) != 0), "left_semi")
    return hit.drop("__at", "__bit")


def held_out(parts: int, part: int):
    """Whether crc32 of the doc_id as text, modulo ``parts``, is ``part``; false without a doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == part, F.lit(False))
