import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark():
    from tsforge.session import session

    s = session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def hours(spark):
    """``hours(start, n, value=..., skip=...)``: an hourly UTC series."""
    from datetime import datetime, timedelta

    def build(start, n, value=lambda i: float(i), skip=(), series="A"):
        first = datetime.fromisoformat(start)
        rows = [(series, first + timedelta(hours=i), value(i)) for i in range(n) if i not in skip]
        return spark.createDataFrame(rows, "series STRING, ts TIMESTAMP, value DOUBLE")

    return build
