"""Spark-native analytics over inspection, detection and trajectory data.

Functions defined here are pickled by value, so a cluster whose executors
lack the package can still run its Arrow functions.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
