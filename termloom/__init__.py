"""Keyword topic clustering as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The functions that run in Python workers travel with their code, so that executors do not need
# the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
