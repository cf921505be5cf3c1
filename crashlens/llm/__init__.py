"""Training-data operators: line, substring and near-duplicate removal, quality
and URL filters, token counts, chat rendering, decontamination, mixing, sharding,
quality classifier, cross-tokenizer alignment, dataset manifest.

Nothing else in the library imports this subpackage.  Its UDFs are sent to Python workers by
value, so that workers need not have the library on their path."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
