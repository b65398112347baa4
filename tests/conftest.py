import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from webspin.session import build_session

    ck = tempfile.mkdtemp(prefix="webspin-test-ckpt-", dir="/tmp")
    s = build_session("local[4]", app="webspin-tests", shuffle_partitions=4,
                      extra={"spark.checkpoint.dir": ck})
    yield s
    s.stop()
