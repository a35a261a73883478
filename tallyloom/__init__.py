"""Spark operators for worklists, reconciliation, ordered analytics, text comparison and graphs."""

import sys

from pyspark import cloudpickle

# functions used inside tasks travel by value, so the executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
