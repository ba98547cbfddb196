"""Every registered query of the time-grid part against its SQL in DuckDB."""

import math

import pytest

from tests.conftest import SMALL
from tidemark.plans import registry


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, int | float):
        return f"{value:.3f}"
    return str(value)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(row[k]) for k in order) for row in found)


def test_every_query_but_the_models_has_sql():
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"model_predictions", "model_rounds", "model_importance", "model_top_contributions", "model_explain_moment"}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = registry.queries()[name](spark, SMALL)
    expected = duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got.columns, got.collect()) == rows(expected.columns, expected.fetchall())


def test_llm_part_is_optional():
    """The registry and its operators don't load the other subpackage."""
    import subprocess
    import sys

    code = "import sys; import tidemark.plans.registry; sys.exit(any(m.startswith('tidemark.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code]).returncode == 0
