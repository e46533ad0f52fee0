"""Training-data pipeline operators. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so executors need neither this package nor its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
