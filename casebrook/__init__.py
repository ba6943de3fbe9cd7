"""Retrieval, summary judging and experiment reports as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the tasks by value, so executors need no
# installation of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
