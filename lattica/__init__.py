"""Lattica: code-graph analytics on Spark DataFrames.

Functions that Spark ships to Python workers are pickled by value, so the
executors need no copy of this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
