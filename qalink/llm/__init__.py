"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions of this package travel to the Python workers by value, so that a cluster needs no copy of it.
register_pickle_by_value(sys.modules[__name__])
