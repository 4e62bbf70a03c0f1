"""slabwise: a PySpark-native analytics engine over immutable blob stores."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Python workers get the package's functions with the task, so executors need no installed copy.
register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
