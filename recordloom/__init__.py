"""Tabular records on Spark: CSV loads, record queries, profiles, exports,
a dataset catalogue and request-rate analytics, all as DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: functions sent to them carry their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
