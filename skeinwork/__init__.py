"""Provenance graphs, operational data and training corpora on Spark."""

import sys

from pyspark import cloudpickle

# functions sent to executors travel whole, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
