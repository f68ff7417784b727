"""Operators for preparing training text: dedup, packing, mixing, language, PII, quality, toxicity.

Nothing outside this subpackage imports it.  ``queries.py`` holds the thin
``opN_<name>`` queries and their SQL; each operator has a module of its own.

Functions that run in Python tasks are sent to the executors by value, so
these need numpy, pyarrow and xxhash, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
