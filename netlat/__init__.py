"""Early warning of network latency on Spark: connection reports, metric
alignment, training sets, scoring and live streams as DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The few Python functions that run in tasks travel with the job, so executors
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
