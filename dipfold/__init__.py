"""Spark-native vetting of periodic signals in irregular time series."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value: nothing has to be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
