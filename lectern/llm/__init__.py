"""Operators for preparing large text corpora for language-model training.

Nothing else in the library imports this package.  Its functions are shipped to
executors by value, so a cluster needs only the public libraries installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
