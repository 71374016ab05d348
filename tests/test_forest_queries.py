"""The registered forests have the reference's trees and depth."""

import inspect

import pytest

from checks import load_all, q_ml, registry


@pytest.mark.parametrize(("name", "function"), [("m04_m05_forest_scores", "forest_report"), ("m06_nested_models", "compare_nested")])
def test_registered_forests_are_whole(monkeypatch, name, function):
    load_all()
    whole = inspect.signature(getattr(q_ml.md, function))

    def note(*args, **named):
        bound = whole.bind(*args, **named)
        bound.apply_defaults()
        raise InterruptedError(bound.arguments["trees"], bound.arguments["depth"])

    monkeypatch.setattr(q_ml.md, function, note)
    monkeypatch.setattr(q_ml, "feature_rows", lambda spark, sf: None)
    with pytest.raises(InterruptedError) as seen:
        registry.QUERIES[name](None, "")
    assert seen.value.args == (100, 10)
