import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from eventide.session import build
    from eventide.streaming.stateful import STATE_STORE

    conf = {k.replace(".", "__"): v for k, v in STATE_STORE.items()}
    s = build(
        "local[8]", "tests", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions="4", spark__driver__memory="6g", **conf,
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
