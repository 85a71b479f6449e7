import json
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture
def entities(spark, tmp_path):
    """Writes rows as an entity file and opens it."""
    from tessella.operators.dataset import Dataset

    def make(rows: list, name: str = "rows.json") -> Dataset:
        (tmp_path / name).write_text(json.dumps({"meta": 1, "entities": rows}))
        return Dataset.json(spark, str(tmp_path / name))

    return make
