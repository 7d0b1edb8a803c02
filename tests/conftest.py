import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    import __spark_entry__ as entry
    from navgrid.session import build_session
    session = build_session("local[4]", "tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    entry._prepare(session)
    yield session
    session.stop()


@pytest.fixture
def panel_of(spark):
    """Panel from {series: {date text: value}}."""
    def build(series: dict):
        rows = [(s, d, float(v)) for s, days in series.items() for d, v in days.items()]
        return spark.createDataFrame(rows, "serie string, data string, valor double").selectExpr(
            "serie", "cast(data as date) as data", "valor")
    return build


def values(df, *columns):
    """Rows as a sorted list of tuples, dates as text."""
    rows = [tuple(str(r[c]) if hasattr(r[c], "isoformat") else r[c] for c in columns or df.columns) for r in df.collect()]
    return sorted(rows, key=str)
