import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from uas_spark.session import build_session
    ckpt = tempfile.mkdtemp(prefix="uas-test-ckpt-")
    s = build_session("local[4]", 4, app="uas_tests", extra={"spark.checkpoint.dir": ckpt,
                                                             "spark.driver.memory": "4g"})
    yield s
    s.stop()


def ts(s):
    import datetime as dt
    return dt.datetime.fromisoformat(s.replace("Z", "")).replace(tzinfo=None)
