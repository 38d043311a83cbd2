import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from partlens.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    with tempfile.TemporaryDirectory(prefix="partlens-tests-") as folder:
        session = get_session("partlens-tests", "local[8]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
                              spark__ui__showConsoleProgress="false", spark__driver__memory="8g", spark__checkpoint__dir=folder)
        session.sparkContext.setLogLevel("ERROR")
        yield session
        session.stop()
