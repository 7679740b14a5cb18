"""Spark-native analytics over panels of time series, event tables, documents and agents."""

import sys

from pyspark import cloudpickle

# task functions travel by value, so executors need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
