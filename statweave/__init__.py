"""Statistical analysis of large tables on Spark.

Every operator takes a DataFrame and returns DataFrames; Spark does the
scanning, grouping, ranking and shuffling, and only small sufficient
statistics ever leave the executors.
"""

import sys

from pyspark import cloudpickle

# Ship the package's own functions with the tasks, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
