"""Demand-planning analytics as plain DataFrame-to-DataFrame functions on Spark."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with the job, so that executors do not need
# this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
