"""Training-data operators: tokenising, search, selection, packing, extraction, deduplication, language models, chat.

Nothing else in the library imports this package.  Task functions are shipped by value, so executors need numpy and
pyarrow but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
