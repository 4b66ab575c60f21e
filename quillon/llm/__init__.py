"""Training-data operators: deduplication, search, classification, redaction, extraction, mixing.

Every operator takes and returns DataFrames and is usable on its own; the registered
queries that derive digest columns from them are in :mod:`quillon.llm.queries`.
Nothing outside this subpackage imports it.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so that executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
