"""PySpark-native analytics over a media metadata catalogue."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors by value, so those need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
