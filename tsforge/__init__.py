"""Preparation and forecasting of many time series on Spark."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

from tsforge.config import PrepConfig, SpotConfig

__all__ = ["PrepConfig", "SpotConfig"]

# The few functions that run in Python workers travel with the job, so that executors need no
# installed copy of this package.
register_pickle_by_value(sys.modules[__name__])
