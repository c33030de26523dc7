"""A PySpark-native engine for declarative map-shuffle-reduce jobs over tables, files and logs."""

import sys

from pyspark import cloudpickle

# Executors need not have this package: what a job refers to travels with it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
