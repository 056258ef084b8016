"""One local session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from corpuscle.plans.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    """The session, with the settings the engine relies on."""
    session = local_session()
    session.conf.set("spark.sql.shuffle.partitions", "2")  # the test tables are tiny
    return session
