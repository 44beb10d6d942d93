import glob
import os

import pytest

from tidewatch.session import build_session

DATA = os.environ.get("TIDEWATCH_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session("tidewatch-tests", cores=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    if not glob.glob(f"{DATA}/*.parquet"):
        pytest.skip(f"no sample tables in {DATA}")
    return DATA
