"""Spark-native analytics for industrial identifier-capture traceability.

Every operator takes DataFrames and returns DataFrames; thresholds and rule tables are arguments.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# functions shipped to Python workers travel with their code, so executors need no installed copy
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
