"""ostinato: an analytics engine for media libraries and text corpora on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python workers then need no copy of this package: functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
