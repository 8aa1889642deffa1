"""Spark-native analytics over session-keyed sensor time series.

Every operator is a DataFrame transformation.  Keys, windows, tolerances and
vocabularies are arguments; the defaults are the values of the data contract.
"""

from driftline.session import build_session

__all__ = ["build_session"]
