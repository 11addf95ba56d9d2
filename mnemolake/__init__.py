"""Agent-memory retrieval and analytics as pure DataFrame transformations on PySpark."""

import sys

from pyspark import cloudpickle

# Functions for executors travel with their code, so that the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
