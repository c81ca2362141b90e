import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tagweave.session import local_session
    s = local_session(4, 8, app="tagweave-tests")
    # tests own their checkpoint folder (a cluster names a shared one)
    if not s.conf.get("spark.checkpoint.dir", None):
        d = tempfile.mkdtemp(prefix="tagweave-ckpt-")
        s.sparkContext.setCheckpointDir(d)
        s.conf.set("spark.checkpoint.dir", d)
    yield s


@pytest.fixture()
def tmpdir_run():
    return tempfile.mkdtemp(prefix="tagweave-run-")


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)
