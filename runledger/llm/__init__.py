"""Operators for preparing training data. Nothing outside this folder imports it."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package
