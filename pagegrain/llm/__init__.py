"""Operators for preparing training text: one module per operator, queries in ``queries``.

Nothing outside this package imports it. Its functions travel to the executors
by value, so these need the libraries but not the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
