"""Operators for a training-data pipeline over `documents`, `pages` and `benchmark`.

Nothing else in the library imports this package.  `queries.py` registers one thin query per
operator; `corpus_pipeline.py` at the repository top chains five of them.
"""
