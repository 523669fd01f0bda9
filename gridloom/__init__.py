"""gridloom: DataFrame-first sales warehousing, tabular analytics and raster operators on Spark."""

import sys

from pyspark import cloudpickle

# Executors get the functions of this package with the tasks; they need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
