"""Posting intake and consolidation as Spark jobs."""

import sys

from pyspark import cloudpickle

# Executors receive the few Python helpers by value, so the package need not be shipped.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
