"""Spark-native operators for interaction proteomics and cell-atlas tables."""

import sys

from pyspark import cloudpickle

# the few functions that run in Python workers travel with the job, so executors need no installation
cloudpickle.register_pickle_by_value(sys.modules[__name__])
