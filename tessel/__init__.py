"""tessel: code-and-document graph analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python functions are sent to executors by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
