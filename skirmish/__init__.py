"""Combat-log analytics on Spark: parse, segment, stamp, aggregate, compare."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with their code, so the
# executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
