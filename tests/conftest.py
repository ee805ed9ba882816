import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("MASKLOOM_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from maskloom.session import session

    s = session(
        "local[4]", "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="3g",
        spark__checkpoint__dir="file://" + str(tmp_path_factory.mktemp("shared")),
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
