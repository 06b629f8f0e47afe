"""Table preparation and tabular learning on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel whole, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
