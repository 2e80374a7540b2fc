import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from leadlake.session import get_session  # noqa: E402


# Made at import, because test modules build column expressions at import too.
SESSION = get_session(
    "leadlake-tests", "local[8]",
    **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.ui.showConsoleProgress": "false",
    },
)
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    return SESSION


@pytest.fixture(scope="session")
def column(spark):
    """Values of an expression over rows of text columns a, b, c, d."""

    def evaluate(rows, expression):
        padded = [tuple(r) + (None,) * (4 - len(r)) for r in rows]
        df = spark.createDataFrame(padded, "a string, b string, c string, d string")
        return [r[0] for r in df.select(expression.alias("x")).collect()]

    return evaluate
