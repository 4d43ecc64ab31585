"""Sinks: time-partitioned append (S10) and keyed replace."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F

# Files of one date that one append writes at most, and the column that a retry is looked up by.
FILES_PER_DATE, KEY = 4, "report_id"
# Share of absent keys that a row group's Bloom filter lets pass: a lookup of hundreds of new keys still
# skips most row groups.
FALSE_HITS = 1e-4


def _bloom(writer: DataFrameWriter, key: str) -> DataFrameWriter:
    """Row groups carry a Bloom filter of ``key`` as large as their keys need, so a lookup of given keys
    skips the groups without them. Of a fixed size it would be 1 MB a file, in small files most of it."""
    return (writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
            .option("parquet.bloom.filter.adaptive.enabled", "true")
            .option(f"parquet.bloom.filter.fpp#{key}", str(FALSE_HITS)))


def _clustered(df: DataFrame, ts_col: str, key: str, files: int) -> DataFrame:
    """Rows dealt by date and a slice of the key, sorted by key within a file: an append makes at most
    ``files`` files a date, however many tasks computed its rows."""
    df = df.withColumn("recorded_date", F.to_date(F.col(ts_col)))
    slot = F.pmod(F.xxhash64(key), F.lit(files))
    return df.repartition("recorded_date", slot).sortWithinPartitions("recorded_date", key)


def append_time_partitioned(df: DataFrame, path: str, ts_col: str = "recorded_at", key: str = KEY,
                            files: int = FILES_PER_DATE) -> None:
    """Append to a table partitioned by ``recorded_date``; readers filtering on time get
    partition pruning (the hypertable's chunk exclusion). Rows are clustered (``_clustered``) and
    row groups carry a Bloom filter of ``key`` (``_bloom``)."""
    _bloom(_clustered(df, ts_col, key, files).write.mode("append"), key).partitionBy("recorded_date").parquet(path)


def write_batch(df: DataFrame, path: str, part: str, ts_col: str = "recorded_at", key: str = KEY,
                files: int = FILES_PER_DATE) -> None:
    """S10 for a micro-batch: the same clustered write into partitions (recorded_date, part) of its own,
    which a replay of the micro-batch overwrites."""
    rows = _clustered(df, ts_col, key, files).withColumn("part", F.lit(part))
    (_bloom(rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic"), key)
     .partitionBy("recorded_date", "part").parquet(path))


def replace_partitions(df: DataFrame, path: str, *partition_cols: str) -> None:
    """Replace the partitions of a keyed table that ``df`` holds rows of; the others stay.
    Spark's own dynamic partition overwrite; ``df`` must not read ``path`` lazily (write it to
    the checkpoint folder first if it does)."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_cols).parquet(path))
