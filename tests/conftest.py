import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from roadrisk.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(cpus=4, shuffle_partitions=4, scratch=tempfile.mkdtemp(prefix="rr-test-ckpt-", dir="/tmp"))
    yield s


@pytest.fixture
def tmpdir_json(tmp_path):
    return tmp_path
