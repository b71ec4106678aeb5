"""Filing-event studies on Spark: from raw disclosure tables to horizon curves."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the workers with the job, so those need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
