"""Document retrieval and text processing on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that they
# need not have it installed or on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
