import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from costlens import session
    spark = (SparkSession.builder.master("local[8]").appName("costlens-tests")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return session.configure(session.local_default(spark))


@pytest.fixture
def root(spark):
    from costlens import session
    return session.run_path(spark, "test")


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
