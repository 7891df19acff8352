"""The model queries walk over all folds."""

import pytest

from panelwise.plans import queries_daily
from panelwise.plans.registry import QUERIES


@pytest.mark.parametrize("name, operator", [("m7_predict_returns", "predict_returns"), ("m9_ablate", "ablate")])
def test_all_folds_are_used(spark, monkeypatch, name, operator):
    seen, whole = [], queries_daily._folds
    monkeypatch.setattr(queries_daily, "_folds", lambda p: seen.append(whole(p)) or seen[0])
    full, used = getattr(queries_daily.model, operator), []
    monkeypatch.setattr(queries_daily.model, operator, lambda df, folds, *a, **b: used.append(folds) or full(df, folds, *a, **b))
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    every = sorted(map(tuple, seen[0].collect()))
    assert len(every) > 1 and sorted(map(tuple, used[0].collect())) == every
