import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from graphvec.session import drop_scratch, local_session

    folder = tmp_path_factory.mktemp("checkpoints")
    s = local_session("*", shuffle_partitions=8, extra={"spark.checkpoint.dir": str(folder)})
    yield s
    drop_scratch(s)
