"""The registry, and every quick query beside its SQL at the smallest scale."""

import ast
import pathlib

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from entries import load

ROOT = pathlib.Path(__file__).resolve().parent.parent
#: Whole jobs and model fits; `tools/check.py` runs all of them.
SLOW = ("ml2_", "ml3_", "ml5_", "ml7_", "ml9_", "ml11_", "ml12_", "sk9_", "nm3_",
        "nm4_incremental", "sk2_", "al4_")


def test_registry():
    q, o = queries(), oracle_sql()
    assert set(o) <= set(q) and set(load()[0]) <= set(q) and len(load()[0]) > 150


def test_entry_point(spark):
    df = entry(spark)
    assert df.count() > 0 and "ensemble_score" in df.columns


@pytest.mark.parametrize("name", [n for n in sorted(load()[1]) if not n.startswith(SLOW)])
def test_query_equals_sql(spark, sf_dir, name):
    from tools.check import compare, connect
    assert compare(queries()[name](spark, sf_dir), connect(sf_dir), oracle_sql()[name]) == ""


def test_the_package_has_no_driver_collects_or_row_udfs():
    for path in (ROOT / "costlens").rglob("*.py"):
        tree = ast.parse(path.read_text())
        names = {n.attr for n in ast.walk(tree) if isinstance(n, ast.Attribute)}
        assert not names & {"collect", "toPandas", "localCheckpoint", "crossJoin", "udf", "rdd"}, \
            path
