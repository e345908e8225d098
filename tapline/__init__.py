"""Network-traffic threat analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from tapline.config import DEFAULT, Config

# Functions used inside tasks travel with the query, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Config", "DEFAULT"]
