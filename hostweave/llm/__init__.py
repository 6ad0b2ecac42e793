"""Training-data operators.  Nothing else in the library imports this package.

Its functions travel to the Python workers by value, so workers need only Spark,
numpy and pyarrow, not this library.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
