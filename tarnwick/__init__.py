"""A PySpark-native analytics engine: relational queries, time series, streams and UDFs as Spark plans.

Functions that run on executors are pickled by value, so executors need no
installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
