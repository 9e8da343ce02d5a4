"""Operations of a training-data pipeline: dedup, search, scoring, mixing, tokenizing.

Nothing else in the library imports this subpackage. Functions that run in Python
workers travel with the task, so executors need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
