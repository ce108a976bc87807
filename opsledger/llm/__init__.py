"""Training-data operators: language id, dedup, search, sharding, mixing, packing, scans, quality.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it. Its
modules are shipped to Python workers by value, so executors need no copy of
the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
