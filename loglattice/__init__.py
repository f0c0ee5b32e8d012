"""loglattice: log normalisation expressed as Spark DataFrame and streaming jobs."""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Ship the package's Arrow functions by value, so executors need no installed copy of it.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
