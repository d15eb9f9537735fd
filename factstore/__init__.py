"""factstore: batch and streaming operations over tables of text memories, on PySpark."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code, so that executors need no copy of
# this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
