"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. Functions that run in Python workers are
pickled by value, so executors need the public libraries only, not this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
