"""Operators for training-data pipelines: one module each, queries in ``queries``."""

from pyspark import cloudpickle

import delimlake.llm as _self

# Executors may not have this package on their path: ship functions by value.
cloudpickle.register_pickle_by_value(_self)
