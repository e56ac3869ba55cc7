"""tokenloom: token-stream analytics and corpus preparation on Spark.

Functions of this package run inside Python workers; they are pickled by
value, so that executors need no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
