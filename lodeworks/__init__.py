"""Spark-native analytics over document collections: quality gates, scoring, retrieval, derivation, graphs and streams."""

import sys

from pyspark import cloudpickle

# Python functions travel to executors by value, so a cluster does not need this package installed on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
