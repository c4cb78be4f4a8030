"""Claimweave: a PySpark-native engine for bitemporal, evidence-bearing claims."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

__version__ = "0.1.0"

# Functions sent to executors travel with the job; executors need no copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
