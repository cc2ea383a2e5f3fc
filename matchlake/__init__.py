"""matchlake: layered match telemetry, round features, document search and run catalogues on PySpark."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their job, so that executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
