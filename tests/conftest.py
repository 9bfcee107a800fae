import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lotline.runtime import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session("lotline-tests", cores="4")
    yield spark
    spark.stop()
