"""Operators for training-data pipelines.

Functions of this package travel to the executors by value, so jobs run where only the driver has
the package on its path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
