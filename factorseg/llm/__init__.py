"""Operators for training-data pipelines. Nothing else in the library imports this subpackage.

Task code of these modules is pickled by value, so executors need Spark, NumPy and PyArrow but no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
