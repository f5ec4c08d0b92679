"""Operators for large training-data pipelines. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions that go to executors travel by value, so that these need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
