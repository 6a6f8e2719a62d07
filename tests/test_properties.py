"""Invariants on random small frames."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradelens.operators import association, fold, outcome, shape
from gradelens.spec import OutcomeSpec

SPEC = OutcomeSpec("outcome", ("low", "mid", "high"), ("low", "mid", "high"))
ROWS = st.lists(st.tuples(st.sampled_from(["a", "b", "c", "d", None]),
                          st.sampled_from(["low", "mid", "high", "other", None])),
                min_size=1, max_size=40)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=ROWS)
def test_breakdown_fold_share_and_v_invariants(spark, rows):
    df = spark.createDataFrame(rows, "key string, outcome string")
    br = outcome.breakdown(df, "key", SPEC).collect()
    assert sum(r["total"] for r in br) == len(rows)
    for r in br:
        assert r["low"] + r["mid"] + r["high"] <= r["total"]
        assert 0.0 <= r["risk"] <= 3.0
    rows_df = outcome.breakdown(df, "key", SPEC)
    folded = fold.fold(rows_df, lambda c: F.when(c.isin("a", "b"), F.lit("ab")).otherwise(c), SPEC)
    kept = sum(r["total"] for r in br if r["key"] is not None)
    assert (folded.agg(F.sum("total")).first()[0] or 0) == kept
    assert shape.with_share(rows_df).agg(F.sum("share")).first()[0] == pytest.approx(1.0)
    v = association.cramers_v(df, ["key"], SPEC).first()["v"]
    assert 0.0 <= v <= 1.0
    assert association.cramers_v(df.orderBy(F.rand(3)), ["key"], SPEC).first()["v"] == v
