import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import fixtures


@pytest.fixture(scope="session")
def docs(spark):
    made = fixtures.documents(spark).cache()
    made.count()
    return made


@pytest.fixture(scope="session")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)
