"""tarn: a PySpark-native lake table engine."""

import sys

from pyspark import cloudpickle

# Functions that go to Python workers go by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
