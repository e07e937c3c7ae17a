"""Spark jobs for document corpora: ingestion, search, quality, classification, deduplication and usage analytics."""

import sys

from pyspark import cloudpickle

# Functions go to Python workers by value: the package need not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
