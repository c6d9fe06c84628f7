import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.host", "127.0.0.1")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def same_rows(a, b) -> bool:
    """Whether two pandas frames have the same rows, whatever their order."""
    import pandas as pd

    columns = sorted(a.columns)
    assert columns == sorted(b.columns)

    def rows(x):
        # whole numbers read as floats, where a column has nulls, count as whole numbers
        plain = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else v
        return sorted(map(repr, [tuple(plain(getattr(v, "item", lambda v=v: v)()) for v in r) for r in x[columns].astype(object).values.tolist()]))

    return rows(a) == rows(b)
