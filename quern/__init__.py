"""quern: a Spark-first engine that grinds messy documents and event logs into trustworthy tables.

Functions of this package that reach executors are pickled by value, so a cluster
needs no copy of the package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
