"""Operators for preparing training data. Nothing else in the library imports this subpackage.

Functions that run in tasks are sent with the task, so executors do not need this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
