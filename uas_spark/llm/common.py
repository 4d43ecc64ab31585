"""Shared helpers: table reading, session settings, reliable checkpoints, text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, ensure_checkpoint_dir

# Rows and bytes of one Arrow batch handed to Python: bounds a worker's memory when texts are long.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on; the checkpoint folder is the cluster's own."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    ensure_checkpoint_dir(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    return ensure_checkpoint_dir(spark).rstrip("/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table as it is stored (no repartitioning, so scan tasks follow its files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it from there."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_bytes(name: str = "text") -> Column:
    """UTF-8 bytes of a text column, null as empty: cheaper to hand to Python than strings."""
    return text_or_empty(name).cast("binary")


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(id_col: str, text_col: str = "text") -> Column:
    """One name for a row by its id and text: rows that share an id but not a text have names of their
    own, and so have rows with a null id; a null text differs from an empty one."""
    i, t = F.col(id_col).cast("string"), F.col(text_col).cast("string")
    return F.concat_ws(":", i.isNull().cast("string"), F.coalesce(i, F.lit("")), F.coalesce(F.md5(t.cast("binary")), F.lit("-")))


def id_bucket(id_col: str, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def word_count_column(col: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` of a text, JVM side."""
    return F.regexp_count(col, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
