"""Operators for preparing training text: scoring, tokenizing, searching, removing copies, sharding."""

import sys

from pyspark import cloudpickle

# Tasks carry this code with them: executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
