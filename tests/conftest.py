import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from marginalia.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]",
        spark_sql_shuffle_partitions="4",
        spark_ui_enabled="false",
        spark_ui_showConsoleProgress="false",
        spark_driver_memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    return session
