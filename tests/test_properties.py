"""Randomised logs: aggregate form == join form == DuckDB twin."""

import duckdb
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from retentia.operators import features as feat
from retentia.plans.oracle import BRANCHES, CLEAN, FEATURE_COLS, with_ctes
from retentia.schema import EVENT
from tests.conftest import T, rows_of

PAGES = ["NextSong", "Thumbs Up", "Thumbs Down", "Add Friend", "Cancellation Confirmation", "Home", None]
LOCS = ["Austin, TX", "Boston-Cambridge, MA-NH", "A, ZZ-QX", " Reno ,\tNV ", None]

row = st.tuples(
    st.sampled_from(["1", "2", "3", "", None]),
    st.sampled_from(PAGES),
    st.integers(min_value=0, max_value=4 * 86400000).map(lambda x: T + (x // 3600000) * 3600000),
    st.sampled_from(["free", "paid", None]),
    st.sampled_from(["M", "F", None]),
    st.sampled_from(LOCS),
)


def _duck(rows):
    con = duckdb.connect()
    pdf = pd.DataFrame(rows, columns=[f.name for f in EVENT.fields]).astype(
        {"userId": "object", "page": "object", "level": "object", "gender": "object", "location": "object"})
    pdf["ts"] = pdf["ts"].astype("int64")
    con.register("activity", pdf)
    sql = f"{with_ctes(CLEAN, BRANCHES)}\nSELECT {FEATURE_COLS} FROM features"
    res = con.execute(sql).fetchall()
    return sorted((tuple(r) for r in res), key=lambda t: tuple((0, "") if x is None else (1, str(x)) for x in t))


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(row, min_size=1, max_size=40))
def test_forms_and_oracle_agree(spark, rows):
    log = spark.createDataFrame(rows, EVENT)
    agg = rows_of(feat.feature_table(log))
    assert agg == rows_of(feat.feature_table_joinform(log))
    assert agg == _duck(rows)
