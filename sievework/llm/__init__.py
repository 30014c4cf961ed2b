"""Operators for preparing training text: thirteen jobs, each with a query over the given tables.

Nothing outside this subpackage imports it.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
