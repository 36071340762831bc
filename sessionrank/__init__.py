"""Session-based recommendation on event logs, as Spark DataFrame functions.

Functions that run in tasks are pickled by value, so executors need no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
