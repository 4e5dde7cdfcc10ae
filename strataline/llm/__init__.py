"""Operators for training-data pipelines.

Nothing else in the package imports this subpackage. Its functions are shipped
to executors by value, so that workers need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
