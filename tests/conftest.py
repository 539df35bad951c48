import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

from panelweave.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="6g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoint")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


# Three units over four periods, unit 1 treated from period 2.
DEMO = [
    (1, 0, 0, 10.0, 1.1, 5.0, 0.2),
    (1, 1, 0, 11.5, 1.0, 5.2, 0.1),
    (1, 2, 1, 13.0, 1.2, 5.1, 0.3),
    (1, 3, 1, 14.2, 1.3, 5.3, 0.2),
    (2, 0, 0, 9.0, 0.8, 4.9, 0.1),
    (2, 1, 0, 9.4, 0.9, 5.0, 0.2),
    (2, 2, 0, 9.9, 0.7, 5.1, 0.1),
    (2, 3, 0, 10.1, 0.8, 5.2, 0.2),
    (3, 0, 0, 8.5, 0.6, 4.7, 0.1),
    (3, 1, 0, 8.9, 0.7, 4.8, 0.2),
    (3, 2, 0, 9.2, 0.6, 4.9, 0.1),
    (3, 3, 0, 9.5, 0.7, 5.0, 0.2),
]
DEMO_SCHEMA = (
    "id bigint, period int, treatment int, outcome double, covariate_1 double, covariate_2 double, covariate_3 double"
)


@pytest.fixture(scope="session")
def demo(spark):
    return spark.createDataFrame(DEMO, DEMO_SCHEMA)


@pytest.fixture(scope="session")
def noisy_panel(spark):
    """40 units by 15 periods with holes; every value from a formula."""
    rows = []
    for i in range(40):
        for t in range(15):
            if (i * 7 + t * 3) % 11 == 0:
                continue
            treat = int(i % 2 == 0 and t >= 6 + i % 3)
            x1 = ((i * 31 + t * 17) % 23) / 7.0
            x2 = ((i * 13 + t * 29) % 19) / 5.0
            noise = ((i * 97 + t * 57) % 101) / 50.0 - 1
            rows.append((i, t, treat, 0.3 * i + 0.1 * t + 1.5 * treat + 0.4 * x1 - 0.2 * x2 + noise, x1, x2))
    return spark.createDataFrame(
        rows, "id bigint, period int, treatment int, outcome double, covariate_1 double, covariate_2 double"
    )
