"""Operators for preparing large text corpora for model training.

Nothing outside this subpackage imports it. Tasks carry its code with them, so executors need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
