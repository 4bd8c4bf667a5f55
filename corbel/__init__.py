"""Spark-first document retrieval analytics."""

import sys

from pyspark import cloudpickle

__version__ = "0.2.0"

# Python functions that run on executors are pickled by value, so a cluster
# needs no installed copy of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
