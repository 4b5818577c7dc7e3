"""netprism: security analytics on network flows, web logs and file contents,
written as Spark DataFrame / ML / Structured Streaming jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package that run in Python workers travel by value, so a
# cluster's workers need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
