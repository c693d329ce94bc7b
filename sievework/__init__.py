"""Table cleaning, feature engineering, profiling and experiment analysis on Spark.

Every operator takes a DataFrame and returns a DataFrame.  Operators that need
constants from the data (means, quantiles, value ranges) fit them with
aggregate jobs first, like a Spark ML estimator, and then apply them as
literals in a plain projection or filter.
"""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the job, so the
# package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
