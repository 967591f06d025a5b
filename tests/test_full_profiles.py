"""The registered queries train the published profiles, all trees and all depths."""

import pytest

from catalog import models
from ebbtide.operators import training


class Stop(Exception):
    pass


@pytest.fixture
def asked(monkeypatch):
    calls = []

    def stop(*args, **changes):
        calls.append((args[1:], changes))
        raise Stop

    monkeypatch.setattr(models, "prepared", lambda spark, folder: (None, None, None))
    monkeypatch.setattr(models, "complete_customers", lambda spark, folder: None)
    monkeypatch.setattr(models.jobs, "build_features", lambda df: (None, None, None))
    monkeypatch.setattr(models.jobs, "compare_models", stop)
    for name in ("train", "train_voting", "train_stacking"):
        monkeypatch.setattr(models.training, name, stop)
    return calls


@pytest.mark.parametrize("name, want", [
    ("train_boosted_by_leaves", (("lgbm-default",), {})), ("impurity_importance", (("rf-default",), {})),
    ("forest_contributions", (("rf-default",), {})), ("contribution_importance", (("rf-default",), {})),
    ("boosted_contributions", (("xgb-conservative",), {})), ("train_voting", ((), {})),
    ("train_voting_by_majority", ((), {"voting": "hard"})), ("train_stacking", ((models.ID,), {})),
    ("model_comparison", ((None, list(training.PROFILES)), {})),
])
def test_query_trains_in_full(asked, name, want):
    with pytest.raises(Stop):
        getattr(models, name)(None, "")
    assert asked == [want]


def test_bins():
    assert set(training.MAX_BINS.values()) == {256}
