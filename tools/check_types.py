"""Compare Spark output types with DuckDB oracle types for every registered key."""
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from uas_spark.plans.registry import ORACLE, QUERIES  # noqa: E402
from uas_spark.session import build_session  # noqa: E402
from uas_spark.sources.tables import TABLES  # noqa: E402

MAP = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
       "date": "DATE", "timestamp": "TIMESTAMP"}


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = build_session("local[4]", 4)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for k in sys.argv[2:] or QUERIES:
        if k.startswith("stream_"):
            continue
        st = {f.name: MAP.get(f.dataType.simpleString(), f.dataType.simpleString())
              for f in QUERIES[k](spark, sf).schema.fields}
        rel = con.sql(ORACLE[k])
        dt = {n: str(t) for n, t in zip(rel.columns, rel.types)}
        diff = {c: (st.get(c), dt.get(c)) for c in set(st) | set(dt) if st.get(c) != dt.get(c)}
        if diff:
            print(k, diff)
    print("done")


if __name__ == "__main__":
    main()
