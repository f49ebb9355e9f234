"""Operations analytics for an online document service, built on PySpark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python functions travel to the executors with the job, so that these need no copy
# of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
