"""Registered queries next to their SQL on the smallest tables.

A few of every family by default; PAIRLOOM_ALL=1 runs them all.
"""

import os

import pytest

from checks import all_queries, all_sql
from checks.compare import TABLES, compare, connect

SF = f"{TABLES}/sf0.001"
SOME = (
    "a04", "a07", "a09", "a10", "a11", "a14", "b01", "b05", "b06_drop", "c01", "c04", "c07", "c09", "d02", "d03", "d08",
    "e08", "e10", "e15", "j01_pitch_shift_up", "j06_convolve_blocks", "j07", "j08", "k02", "k03_refresh_counts", "k04",
    "f03", "f04", "f06", "f07", "f09", "f15", "g03", "g09", "g10", "h04", "h05", "h06", "i05", "i10", "i16", "i19",
    "s01", "s02", "u01", "u02", "z01",
)
NAMES = [n for n in all_queries() if os.environ.get("PAIRLOOM_ALL") or n.startswith(SOME)]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    ok, note, _ = compare(spark, SF, name, all_queries()[name], all_sql().get(name), con)
    assert ok, note


def test_sql_has_a_query():
    assert set(all_sql()) <= set(all_queries())
