"""Operators for training-data pipelines. Nothing else in the library imports this package.

Worker functions of this package travel to the executors by value, so the library need not be
installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
