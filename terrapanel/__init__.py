"""Place-by-day surveillance panels as Spark DataFrame jobs.

Functions that run in Python workers are pickled by value, so executors need not have this package.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
