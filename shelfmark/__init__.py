"""Catalogue extraction and analytics over tables of crawled store pages, on Spark."""

import sys

from pyspark import cloudpickle

# Ship the few Python functions with the job, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
