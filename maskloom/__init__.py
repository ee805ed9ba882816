"""maskloom: a Spark-native engine for corpora of contextual entity substitutions."""

import sys

from pyspark import cloudpickle

# Python workers need not have the package on their path: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
