"""Spark-native preparation and measurement of language-model training data."""

import sys

from pyspark import cloudpickle

# Arrow kernels are closures defined in this package. Shipping them by value lets executors run
# them without the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
