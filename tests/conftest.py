import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from millrace.session import build, drop_written

    session = build("local[4]", partitions=4, spark__driver__memory="4g", spark__checkpoint__dir="/tmp/checkpoints")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_written(session)
    session.stop()
