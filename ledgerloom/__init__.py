"""Spark-native profiling, cleaning, matching and consolidation of business tables."""

import sys

from pyspark import cloudpickle

# Functions of this package travel inside the task, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .session import build_session, configure, stable  # noqa: E402

__all__ = ["build_session", "configure", "stable"]
