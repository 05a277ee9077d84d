"""Operators for training-data pipelines; nothing else in the library needs them."""

import sys

from pyspark import cloudpickle

# What runs in tasks travels with the job: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
