"""orderlens: order-risk analytics as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers by value, so that a cluster needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
