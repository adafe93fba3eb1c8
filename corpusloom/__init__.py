"""Spark-native keeping, searching and checking of large note collections."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

__version__ = "0.1.0"

# Small per-batch helpers travel with the job, so executors need no installed copy.
register_pickle_by_value(sys.modules[__name__])
