"""Price-book matching and governance on Spark."""
import sys

from pyspark import cloudpickle

# Functions for Python workers travel by value, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
