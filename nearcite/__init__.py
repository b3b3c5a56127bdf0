"""Similarity search over citation-linked corpora, expressed as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with them, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
