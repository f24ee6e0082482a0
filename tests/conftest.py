import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from tidemark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(shared=str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """``rows(ddl, tuple, …)``: a small frame."""
    def make(ddl, *values):
        return spark.createDataFrame(list(values), ddl)

    return make
