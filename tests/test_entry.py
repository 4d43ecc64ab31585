import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


def test_entry_smoke(spark):
    m = _entry()
    df = m.entry(spark)
    assert df.count() > 0
    assert df.columns == ["probe_id", "zone_id", "report_id", "state"]


def test_every_query_has_an_oracle_or_is_listed(spark):
    m = _entry()
    from uas_spark.plans import registry
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q)
    assert set(registry.ORACLE) == set(registry.QUERIES) <= set(o)


def test_small_queries_run(spark):
    m = _entry()
    for k in ["latest_position", "registration_sequential_accept", "authorization_lifecycle", "sun_times",
              "val_spatial_probe", "downsample_track"]:
        assert m.queries()[k](spark, "/root/testdata/sf0.001").count() >= 0
