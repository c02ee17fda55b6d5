import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bibspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", app="bibspark-tests", **{"spark.sql.shuffle.partitions": "8",
                                                    "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bibspark-tests-")})
    yield s


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]
