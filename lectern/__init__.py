"""A PySpark-native engine for document briefs and training corpora.

Functions of this package are shipped to executors by value: a cluster needs only the public libraries.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
