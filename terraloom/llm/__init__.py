"""Operators for training-data pipelines; see `registry` for their registered queries."""
