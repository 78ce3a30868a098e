import sys
import tempfile
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quorica.session import configure  # noqa: E402
from quorica.sources.schemas import RAW_SCHEMAS  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def raw_rows(spark):
    """Factory of raw rows: name of the table, then dicts with the columns that matter."""

    def make(table, *rows):
        schema = RAW_SCHEMAS[table]
        return spark.createDataFrame([tuple(row.get(f.name) for f in schema) for row in rows], schema)

    return make


def at(text):
    return datetime.fromisoformat(text)


def rows_of(df):
    return [row.asDict() for row in df.collect()]
