"""Operators for training-data pipelines; each module is one operator, ``queries`` applies them to the given tables."""

import sys

from pyspark import cloudpickle

# Functions of these modules travel to the Python workers whole, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
