"""Tickloom: indicator scripts over ordered bars, planned as Spark columns."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run on executors travel by value, so a cluster needs no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
