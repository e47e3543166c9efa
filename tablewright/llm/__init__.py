"""Operators that prepare text corpora for language model training.

Nothing else in the library imports this package. Its functions run inside Spark tasks, so they
are pickled by value: executors need Spark, numpy and xxhash, not this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
