import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from lapforge.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Sorted tuples of the named columns."""

    def collect(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))

    return collect


@pytest.fixture
def history(spark):
    """Three races: VER finishes 1, 1, 5 and NOR 4, 2, 2."""
    data = [
        (2022, 13, "VER", "Red Bull Racing", 10, 1, 25.0),
        (2022, 13, "NOR", "McLaren", 4, 4, 12.0),
        (2022, 13, "HAM", "Mercedes", 7, 2, 18.0),
        (2022, 13, "LEC", "Ferrari", 3, None, 0.0),
        (2023, 11, "VER", "Red Bull Racing", 2, 1, 25.0),
        (2023, 11, "NOR", "McLaren", 3, 2, 18.0),
        (2023, 11, "HAM", "Mercedes", 1, 4, 12.0),
        (2024, 13, "VER", "Red Bull Racing", 3, 5, 10.0),
        (2024, 13, "NOR", "McLaren", 1, 2, 18.0),
        (2024, 13, "PIA", "McLaren", 2, 1, 25.0),
    ]
    df = spark.createDataFrame(
        data,
        "season_year int, round_number int, driver_code string, team string, grid_position int, finish_position int, points double",
    )
    return df.selectExpr(
        "*", "'Hungarian Grand Prix' AS circuit_name", "CASE WHEN finish_position IS NULL THEN 'Retired' ELSE 'Finished' END AS status"
    )
