"""All queries of this library but those on training-data corpora."""

from __future__ import annotations

from . import boosting, exchange, modelling, splitting, tabular  # noqa: F401  (importing them registers their queries)

QUERIES, ORACLES = tabular.QUERIES, tabular.ORACLES
FLAGSHIP = tabular.QUERIES["vertical_iv"]
