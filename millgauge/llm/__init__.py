"""Operators for building training corpora, each a Spark job over whole tables.

Functions that run in tasks travel by value, so executors need not have this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
