"""Spark operators for build-log anomaly analytics."""

import sys

from pyspark import cloudpickle

# Python workers get the functions themselves, so that jobs run on executors
# where the package is not installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
