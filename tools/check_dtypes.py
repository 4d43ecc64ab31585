"""Compare pandas dtypes of queries (Spark toPandas vs DuckDB df): those named, or every non-streaming one."""
import os, sys; sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import duckdb
from uas_spark.session import build_session
from uas_spark.plans.registry import QUERIES, ORACLE
from uas_spark.sources.tables import TABLES
spark = build_session("local[4]", 4)
sf = "/root/testdata/sf0.01"
con = duckdb.connect()
for t in TABLES: con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
bad = []
for k in sys.argv[1:] or [k for k in QUERIES if not k.startswith("stream_")]:
    sdf = QUERIES[k](spark, sf)
    nullable_int = [f.name for f in sdf.schema.fields]
    if not nullable_int: continue
    pd_s = sdf.select(*nullable_int).toPandas()
    pd_d = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in nullable_int)} FROM ({ORACLE[k]})").df()
    for c in nullable_int:
        if str(pd_s[c].dtype) != str(pd_d[c].dtype):
            bad.append((k, c, str(pd_s[c].dtype), str(pd_d[c].dtype)))
print(bad)
