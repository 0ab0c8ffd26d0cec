import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from inkwell.session import local_session

    s = local_session("inkwell-tests", cpus=4, partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
