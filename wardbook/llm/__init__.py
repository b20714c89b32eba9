"""Operators that prepare text and vectors for training, each a Spark job of its own."""

import sys

from pyspark import cloudpickle

# Functions of this package travel with the tasks, so that executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
