import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loanscope.session import configure, drop_shared  # noqa: E402

SMALLEST = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    drop_shared(session)
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMALLEST


@pytest.fixture(scope="session")
def credits(spark, sf_dir):
    from checks import loans
    return loans.credits(spark, sf_dir)


@pytest.fixture(scope="session")
def raw(spark, sf_dir):
    from checks import loans
    return loans.loans_raw(spark, sf_dir)
