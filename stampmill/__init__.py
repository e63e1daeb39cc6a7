"""Preparing and measuring sky-survey image cutouts as Spark jobs."""

import sys

from pyspark import cloudpickle

# The small functions used inside tasks travel with the job, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
