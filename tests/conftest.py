import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tallyscope import get_session
    from tallyscope.session import clear_scratch

    session = get_session(
        "tallyscope-tests", "local[8]", spark__sql__shuffle__partitions="4", spark__driver__memory="8g", spark__ui__enabled="false"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear_scratch(session)
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL
