"""Training-data operators over documents, pages and benchmark tables.

Functions of this package run inside Python workers.  They are pickled by value, so an executor does
not need this repository on its own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
