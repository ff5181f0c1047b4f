import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def awkward(spark, tmp_path_factory):
    """Folder of the awkward tables."""
    from fixtures import write_tables

    return write_tables(spark, tmp_path_factory.mktemp("awkward") / "t", extra=True)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    """Folder of tables without rows."""
    from fixtures import write_tables

    return write_tables(spark, tmp_path_factory.mktemp("empty") / "t", [], [], [], [])
