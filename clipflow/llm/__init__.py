"""Operators for preparing training text, vectors and web pages at corpus scale."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so no installation is needed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
