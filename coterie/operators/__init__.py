"""Table operators: selection, cleaning, features, intersection, models, metrics."""
