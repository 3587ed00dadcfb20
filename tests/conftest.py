import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from compare import spark_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = spark_session()
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session
