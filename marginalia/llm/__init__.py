"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it.  Its functions are pickled by value, so that
Python workers need no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
