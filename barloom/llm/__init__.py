"""Operators for training-data pipelines; nothing else in the library imports this subpackage.

Functions that run inside tasks are pickled by value, so workers need no copy
of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
