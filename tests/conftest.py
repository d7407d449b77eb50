import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from veilframe.session import local_session, checkpoint_dir
    s = local_session(cores="*", shuffle_partitions=8, app="veilframe-tests")
    checkpoint_dir(s)
    yield s


@pytest.fixture()
def tmp_out(tmp_path):
    return str(tmp_path)
