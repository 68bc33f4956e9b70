import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MED = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from quarry.session import ROCKSDB_CONF, get_spark
    s = get_spark(master="local[4]", shuffle_partitions=8, extra=ROCKSDB_CONF)
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-test-ckpt-", dir="/tmp"))
    yield s


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="quarry-test-", dir="/tmp")
