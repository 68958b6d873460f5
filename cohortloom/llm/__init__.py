"""Operators of a training-data pipeline over tables of documents, pages and benchmark items.

Nothing outside this package and `corpus_pipeline.py` imports it."""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
