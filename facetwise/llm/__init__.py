"""Training-data operators (sharding, tokenising, language ID, near-duplicate joins,
binary token output, decontamination, quality rules, substring and line dedup,
secret scans). Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py``
imports it."""
import sys

from pyspark import cloudpickle

# Functions of this folder travel to Python workers by value, so executors need no
# copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
