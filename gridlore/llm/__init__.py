"""Operators for preparing training text: deduplication, mixing, search, filters, token counts and packing."""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel with the job: executors need numpy, pyarrow and the tokenizers, not this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
