"""Season analytics on Spark: rates, normalization, ranking, scoring, neighbours, units and models."""

from pyspark import cloudpickle as _cloudpickle

import sys as _sys

# Task functions travel with the job, so executors need no installed copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
