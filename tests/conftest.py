import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mendframe.session import local_session
from samples import SCHEMA, passenger_rows


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="4g", app="tests")
    yield session


@pytest.fixture(scope="session")
def dirty(spark):
    """Passengers with one defect of five kinds."""
    return spark.createDataFrame(passenger_rows(), SCHEMA)


@pytest.fixture(scope="session")
def clean(spark):
    ages = [30, 25, 40, 35, 28, 45, 33, 29, 38, 22]
    rows = [
        (r[0], r[1], ages[i], r[3], r[4]) for i, r in enumerate(passenger_rows(fare5=12.0, name8="Heidi"))
    ]
    return spark.createDataFrame(rows, "id long, name string, age long, fare double, survived long")


@pytest.fixture(scope="session")
def classes(spark):
    rows = [(1, "First", 30.0), (2, "Second", 10.0), (3, "Third", 5.0), (4, "Fourth", 3.0), (5, "Fifth", 2.0)]
    return spark.createDataFrame(rows, "id long, class_name string, min_fare double")
