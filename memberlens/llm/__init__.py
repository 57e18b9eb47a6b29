"""Operators for preparing training data; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Tasks carry the code they run, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
