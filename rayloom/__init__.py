"""Detections on street imagery as Spark DataFrames, and training-data operators beside them."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: those need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
