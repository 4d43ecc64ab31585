"""Reading the driver's parquet tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one test table; ``timestamp_ntz`` columns become UTC ``timestamp``.

    Only the columns a query later selects are read (parquet column pruning), and
    filters on them reach the scan as pushed filters. Scan tasks follow the files: nothing
    is dealt out anew.
    """
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.TimestampNTZType):
            cols.append(F.col(f.name).cast("timestamp").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
