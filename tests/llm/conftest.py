import pathlib

import pytest

SMALL = pathlib.Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def small():
    if not SMALL.exists():
        pytest.skip("no test tables")
    return str(SMALL)
