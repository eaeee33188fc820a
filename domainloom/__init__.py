"""domainloom: DataFrame operators for embedding-based domain annotation on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions travel to the executors by value, so these need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
