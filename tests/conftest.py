import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.helpers import rows_of  # noqa: E402
from voxelloom.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", cpus=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """Label frame of one or several numpy volumes."""

    def build(*arrays, kind="long", name="label"):
        rows = [r for i, a in enumerate(arrays) for r in rows_of(np.asarray(a), i)]
        return spark.createDataFrame(rows, f"volume_id long, z long, y long, x long, {name} {kind}")

    return build


@pytest.fixture(scope="session")
def shapes(spark):
    def build(*arrays):
        return spark.createDataFrame([(i, *np.asarray(a).shape) for i, a in enumerate(arrays)], "volume_id long, nz long, ny long, nx long")

    return build
