"""coterie: multi-party analytics and training-data jobs on PySpark."""
