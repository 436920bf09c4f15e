"""Training-data operators. Nothing else in the library imports this package.

Functions that run inside Spark tasks are pickled by value, so executors do
not need this package on their import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
