import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from basketry.session import local_session

    ckpt = tempfile.mkdtemp(prefix="basketry-test-ckpt-")
    s = local_session(cpus="*", partitions=8, app="basketry-tests",
                      extra={"spark.checkpoint.dir": ckpt})
    yield s
    s.stop()
