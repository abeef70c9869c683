import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from steadypace.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]", "tests", spark__sql__shuffle__partitions="2", spark__driver__memory="4g",
        spark__driver__extraJavaOptions="-XX:TieredStopAtLevel=1",
        spark__ui__showConsoleProgress="false", spark__sql__maxMetadataStringLength="1000",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def folder():
    if not os.path.isdir(SF):
        pytest.skip("generated tables are not here")
    return SF
