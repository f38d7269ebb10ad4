"""Every registered query with an oracle equals DuckDB on the fixture view (sf0.001; most also at sf0.01).

The queries that look at the full-size model fits share one training run, which takes minutes; they run at sf0.001.
"""

import pytest

from tests.conftest import SF_MID, SF_SMALL
from tests.oracle import compare


def _registry():
    import __spark_entry__ as E
    return E.queries(), E.oracle_sql()


QUERIES, ORACLES = _registry()
FITS = {"feature_importance", "model_scores", "model_choice", "model_roundtrip", "artifacts_roundtrip", "stream_scores"}
# queries of the optional subpackage have tests of their own
OWN = [n for n in sorted(ORACLES) if n != "pipeline" and not n.startswith("op")]
MID = [n for n in OWN if n not in FITS and not n.startswith("stream_")] + ["stream_serving_features"]


def test_every_query_is_registered_with_callable():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 50


@pytest.mark.parametrize("name", OWN)
def test_query_matches_duckdb_small(spark, duck_small, name):
    ok, msg = compare(QUERIES[name](spark, SF_SMALL), duck_small, ORACLES[name])
    assert ok, msg


@pytest.mark.parametrize("name", MID)
def test_query_matches_duckdb_mid(spark, duck_mid, name):
    ok, msg = compare(QUERIES[name](spark, SF_MID), duck_mid, ORACLES[name])
    assert ok, msg


def test_every_query_of_the_library_has_an_oracle():
    assert [n for n in QUERIES if n not in ORACLES and n != "pipeline" and not n.startswith("op")] == []
