"""Spark-native extended BWT and conjugate-array engine for collections of strings."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions of this package travel to the executors whole, so that it need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
