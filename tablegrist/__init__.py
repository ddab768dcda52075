"""tablegrist: tables and plain-text documents as searchable Spark datasets.

Everything is a function from DataFrame (or Column) to DataFrame (or Column);
jobs run when the caller writes or reads the result.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python UDFs travel to the executors by value, so the package need not be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
