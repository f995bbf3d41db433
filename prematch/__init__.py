"""Point-in-time analytics over two-sided contests, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel with the plan, so a cluster needs no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
