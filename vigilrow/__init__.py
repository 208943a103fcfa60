"""Source-file threat triage as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Small helpers travel to the executors with the job: nothing to install there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
