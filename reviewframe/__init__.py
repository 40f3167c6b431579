"""Code-review analytics over Spark DataFrames and streams."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so no node needs the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
