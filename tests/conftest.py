import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from retentia.schema import EVENT  # noqa: E402
from retentia.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"

T = 1538352000000  # 2018-10-01 00:00:00 UTC
LOC1 = "Boston-Cambridge-Newton, MA-NH"

# The 13-row unit log (userId, page, ts, level, gender, location).
UNIT_ROWS = [
    ("1", "NextSong", T, "free", "F", LOC1),
    ("1", "NextSong", T + 60000, "free", "F", LOC1),
    ("1", "Thumbs Up", 1538438399999, "free", "F", LOC1),
    ("1", "NextSong", 1538438400000, "paid", "F", LOC1),
    ("1", "Cancellation Confirmation", 1538611200000, "paid", "F", LOC1),
    ("2", "NextSong", T, "paid", "M", "Dallas, TX"),
    ("2", "Add Friend", T + 1, "paid", "M", "Dallas, TX"),
    ("3", "Thumbs Down", T, "free", "M", "Austin, TX"),
    ("", "Home", T, "free", None, None),
    (None, "Home", T, "free", None, None),
    ("4", "NextSong", T, "free", "F", None),
    ("5", "NextSong", T, "free", "F", "Anaheim, CA"),
    ("5", "Thumbs Up", T, "paid", "F", "Anaheim, CA"),
]

UNIT_EXPECTED = [
    ("1", "F", 1, "paid", 3, "NH", 1.5, 1.67, 1, 0, 0),
    ("2", "M", 0, "paid", 0, "TX", 1.0, 2.0, 0, 0, 1),
    ("5", "F", 0, "paid", 0, "CA", 1.0, 2.0, 1, 0, 0),
]


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[*]", shuffle_partitions=8, app_name="retentia-tests")
    yield s


@pytest.fixture(scope="session")
def unit_log(spark):
    return spark.createDataFrame(UNIT_ROWS, EVENT)


def rows_of(df, order=None):
    cols = order or df.columns
    return sorted((tuple(r) for r in df.select(*cols).collect()),
                  key=lambda t: tuple((0, "") if x is None else (1, str(x)) for x in t))
