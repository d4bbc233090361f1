"""Operators of a training-data pipeline over text, vectors and URLs."""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so that executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
