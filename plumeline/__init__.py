"""Spark-native analytics that attribute an observed event to its most plausible source."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code, so that workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
