"""Structural-monitoring analytics expressed as Spark DataFrame programs."""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so executors need neither this package nor its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
