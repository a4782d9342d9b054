"""Models from plain settings, as they stand in a JSON file: {"model": name, setting: value, ...}."""

from __future__ import annotations

import json
from dataclasses import MISSING, fields

from .functions.crypto import Paillier
from .operators.kmeans import SeededKMeans
from .operators.linear import LinearModel
from .operators.neural import SplitNetwork
from .operators.private_trees import PassiveParty, PrivateBoostedTrees
from .operators.trees import BoostedTrees, TreeParams

MODELS = {"linear": LinearModel, "logistic": LinearModel, "trees": BoostedTrees, "private_trees": PrivateBoostedTrees, "kmeans": SeededKMeans, "network": SplitNetwork}

#: Settings that training finds; they are no choice of a user.
_FOUND = {"weights", "history", "trees", "edges", "centres", "inertias"}


def _made(kind: type, settings: dict, what: str):
    """A dataclass from settings; unknown and missing ones are errors, lists stand for tuples."""
    known = {f.name: f for f in fields(kind) if f.name not in _FOUND}
    if unknown := sorted(set(settings) - set(known)):
        raise ValueError(f"{what} has no settings {unknown}; it has {sorted(known)}")
    needed = {n for n, f in known.items() if f.default is MISSING and f.default_factory is MISSING}
    if missing := sorted(needed - set(settings)):
        raise ValueError(f"{what} needs settings {missing}")
    return kind(**{n: tuple(v) if isinstance(v, list) and isinstance(known[n].default, tuple | None) else v for n, v in settings.items()})


def from_config(config: dict | str):
    """A model with fit and predict from a dictionary, or from the path of a JSON file. Trees take params of
    TreeParams; trees between parties take parties as a list of {name, features} and key as {bits, seed}."""
    if isinstance(config, str):
        with open(config) as f:
            config = json.load(f)
    settings = dict(config)
    name = settings.pop("model", None)
    if name not in MODELS:
        raise ValueError(f"no model named {name}; there are {sorted(MODELS)}")
    if name == "logistic":
        settings["logistic"] = True
    if "params" in settings:
        settings["params"] = _made(TreeParams, settings["params"], "params")
    if name == "private_trees":
        settings["parties"] = [_made(PassiveParty, p, "a party") for p in settings.get("parties", [])]
        settings["key"] = Paillier.generate(**settings.get("key", {}))
    return _made(MODELS[name], settings, name)
