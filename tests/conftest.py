from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__  # noqa: E402,F401  (ships Python functions by value)
from brookmill.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def event_log_dir(tmp_path_factory):
    return tmp_path_factory.mktemp("eventlog")


@pytest.fixture(scope="session")
def named_folder(tmp_path_factory):
    """The folder a cluster would name for cut lineage."""
    return tmp_path_factory.mktemp("shared")


@pytest.fixture(scope="session")
def spark(event_log_dir, named_folder):
    session = local_session(
        "tests", 4,
        **{"spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file:{event_log_dir}", "spark.eventLog.compress": "false",
           "spark.checkpoint.dir": str(named_folder)},
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL
