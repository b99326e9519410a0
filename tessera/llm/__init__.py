"""Operators for preparing language-model training data.

Each module holds one operator with a general interface; ``queries`` applies
them to the test tables as ``opN_<name>``. Nothing outside this package
imports it.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with their code, so the
# package itself need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
