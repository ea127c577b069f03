"""PySpark-native engine for declarative geospatial feature processing."""

import sys

from pyspark import cloudpickle

# Functions travel to executors by value, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
