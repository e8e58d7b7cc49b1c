"""Cohort, signal and resampling analytics as Spark DataFrame operators."""
import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few numeric kernels that run inside Python workers travel with the job,
# so executors need no separately installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
