"""Spark-native corpus engine for fetched web and documentation pages."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The Python helpers travel with their tasks, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
