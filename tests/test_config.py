"""Models from plain settings."""

import json

import pytest

from coterie.config import from_config
from coterie.operators.linear import LinearModel
from coterie.operators.trees import BoostedTrees, TreeParams


def test_models_from_settings(tmp_path):
    m = from_config({"model": "logistic", "features": ["a", "b"], "label": "y", "epochs": 3, "penalty": "l1", "best_by": ["auc", "ks"]})
    assert m == LinearModel(["a", "b"], "y", logistic=True, epochs=3, penalty="l1", best_by=("auc", "ks"))
    path = tmp_path / "trees.json"
    path.write_text(json.dumps({"model": "trees", "features": ["a"], "label": "y", "id_col": "id", "task": "multi", "params": {"max_depth": 2, "goss": [0.3, 0.2]}}))
    t = from_config(str(path))
    assert isinstance(t, BoostedTrees) and t.params == TreeParams(max_depth=2, goss=(0.3, 0.2)) and t.task == "multi"
    p = from_config({"model": "private_trees", "features": ["a"], "label": "y", "id_col": "id", "parties": [{"name": "two", "features": ["b"]}], "key": {"bits": 128, "seed": 1}})
    assert p.parties[0].name == "two" and 126 <= p.key.n.bit_length() <= 128
    for wrong in ({"model": "nothing"}, {"model": "linear", "features": ["a"]}, {"model": "linear", "features": ["a"], "label": "y", "speed": 9}, {"model": "trees", "features": ["a"], "label": "y", "id_col": "id", "params": {"depth": 1}}, {"model": "linear", "features": ["a"], "label": "y", "weights": [1.0]}):
        with pytest.raises(ValueError):
            from_config(wrong)


def test_a_configured_model_trains(spark):
    df = spark.createDataFrame([(i, float(i % 5), 2.0 * (i % 5)) for i in range(40)], "id long, a double, y double")
    m = from_config({"model": "linear", "features": ["a"], "label": "y", "epochs": 30, "learning_rate": 0.1}).fit(df)
    assert m.weights == pytest.approx([2.0], abs=1e-3)
