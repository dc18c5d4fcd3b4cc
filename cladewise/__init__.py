"""Cladewise: Spark-native phylogenetic analytics.

Functions that run inside Python workers are pickled by value, so executors
need NumPy, pandas and pyarrow but not this package itself.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
