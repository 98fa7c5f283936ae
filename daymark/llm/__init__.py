"""Operators for preparing text corpora; each module docstring states method, inputs and edge cases.

Functions of this package that run in Spark's Python workers travel with their task by value, so executors need pyarrow,
numpy and the like but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
