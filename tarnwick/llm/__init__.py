"""Operators for preparing training data at corpus scale.

Nothing else in the library imports this subpackage; removing it leaves the
relational engine intact.  Functions that run on executors are pickled by
value, so executors need no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
