import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def extracts(tmp_path_factory):
    """The two-entity January fixture as exported CSV files."""
    from fixture_rows import write_extracts

    return write_extracts(tmp_path_factory.mktemp("extracts"))


@pytest.fixture(scope="session")
def loaded(spark, extracts, tmp_path_factory):
    """(counts, core tables) of the fixture after a published load."""
    from prodseries.sources.load import Snapshot, core_tables, load

    out = str(tmp_path_factory.mktemp("store"))
    counts = load(spark, *extracts, out, Snapshot(daily_rows=20, wellbores=2))
    return counts, core_tables(spark, out)


@pytest.fixture(scope="session")
def fixture(loaded):
    """(fact, dimension) of the fixture in role names."""
    from prodseries import SeriesSpec

    spec = SeriesSpec()
    core = loaded[1]
    return spec.fact(core["daily_production"]), spec.dimension(core["wellbore"])
