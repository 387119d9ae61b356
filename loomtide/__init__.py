"""Loomtide: task-store analytics and note extraction on PySpark."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value: workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
