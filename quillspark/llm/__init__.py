"""Operators for training-data pipelines; nothing else in the library imports this subpackage.

Functions that run on executors are pickled by value, so executors need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
