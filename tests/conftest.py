from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerspark.session import local_session  # noqa: E402

# started here, since column expressions at the top of a test file need a session
SESSION = local_session("tests", "4")
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    SESSION.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    return SESSION


@pytest.fixture(scope="session")
def hall(spark):
    """Ledgers of the climbing hall; values shared by tests are in hall.py, none in a conftest."""
    import hall as shared

    return shared.ledgers(spark)
