import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_data import frame, odd_rows  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, odd_rows()).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
