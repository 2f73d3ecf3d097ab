"""graphloom: code-property-graph analytics as Spark DataFrame plans."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# functions go to Python workers with their code, so executors need no copy of this package
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
