import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from jobscope.session import get_spark

    s = get_spark(master="local[4]", **{"spark.sql.shuffle.partitions": "4"})
    s.sparkContext.setLogLevel("OFF")
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="jobscope-test-ckpt-"))
    yield s


SF_SMALL = "/root/testdata/sf0.001"
