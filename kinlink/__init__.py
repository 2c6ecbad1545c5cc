"""Fuzzy record linkage and size-guarded cross-tabs as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Ship this package's Arrow functions inside the task closure, so that executors
# do not need the package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
