"""Every registered query against its SQL on the smallest driver data."""

from __future__ import annotations

import re

import pytest
from compare import connect, difference

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, con, name):
    assert difference(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_has_rows(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0


def test_entry_has_a_stable_schema(spark):
    first, second = entry.entry(spark), entry.entry(spark)
    assert first.schema == second.schema and first.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


SURVEYED = (
    "S1 S2 S3 S4 S5 S6 S7 S9 S10 P1 P3 P4 P5 P6 P7 P8 P9 P11 P12 P13 P14 P15 P16 P17 P18 P19 P20 P21 P22 P23 P24 "
    "J1 J2 J3 J4 J5 J6 A1 A2 A3 A4 A5 A6 A7 A8 A9 A10 A11 A12 A13 A14 A15 A16 A17 A18 A19 A20 A21 A22 A23 A24 A25 A26 "
    "A27 A28 A29 A30 A31 A32 A33 A34 W1 W2 W3 W4 W5 W6 W7 M1 M2 M3 M4 M5 M6 L1 L2 L3 L4 L5 L6 L7 L8 L9 L10 L11 L12 L13"
).split()


def test_every_surveyed_operator_has_a_query():
    found = {m.group().upper() for m in (re.match(r"[a-z]\d+", name) for name in entry.queries()) if m}
    assert len(SURVEYED) == 97 and set(SURVEYED) <= found
