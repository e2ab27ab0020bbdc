"""tidegrid: gridded and indexed monthly time series as Spark DataFrames.

Fields are long tables (one row per member, month and cell); every operator takes
DataFrames and returns DataFrames, so Catalyst sees one declarative plan.
"""

import sys

from pyspark import cloudpickle

from tidegrid.session import build_session

# Kernels travel to the executors inside the task, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]
