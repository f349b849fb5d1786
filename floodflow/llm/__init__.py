"""Training-data operators: one module per operator, queries in ``catalog``."""

import sys

from pyspark import cloudpickle

# Task code travels by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
