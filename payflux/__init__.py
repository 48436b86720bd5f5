"""Spark-first analytics for payment graphs: features, graph building, statistics and anomaly ranking."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions travel to the executors by value, so that this package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
