"""Operators of a pipeline that prepares training data, each as a Spark job over whole tables.

Functions of this subpackage travel to the executors with the task, so it need not be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
